"""Near-duplicates by SuperMinHash.

1. Every text becomes its set of 5-word shingles, and the set a SuperMinHash signature of SIGNATURE values: each shingle
   walks a random permutation of the slots and offers rank + uniform to each, so that ranks over slots are correlated
   and the variance is below MinHash's; the walk stops at the rank from which no slot can improve.
2. Texts with one set collapse into one class, represented by its row of smallest doc_id. Classes have numbers of their
   own, and rows are told apart by a hash of id and text, so that neither null nor repeated ids matter.
3. Bands of ROWS values deal representatives into buckets. A bucket's members are compared with its smallest id only,
   so a bucket of k members gives k - 1 candidates. One bit of each signature value estimates the similarity first.
4. Candidates are verified on full shingle sets, made again from the texts.
5. Union-find: connected components over the links. Members of a bucket that are one component by now need nothing more.
   Other buckets are compared once more with a central member (the one most like the leader), and components are joined.
   Documents that share a bucket with another component even then are joined exactly, by a prefix filter over their
   shingles, so that no pair that shares a bucket is left undecided, and none is compared only for sharing one.

Defined results: a null, empty or blank text has no shingle, links with nothing and is kept; equal sets are linked
whatever the texts; a repeated doc_id is a document in the component of each of its texts, and rows of one doc_id and
text are one document; a null doc_id is compared as any other, and is kept if its component has no other id (one text of
it, if there are several); an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Remembered, materialize, quoted, slices, to_python, unused
from .components import connected_components
from .shingles import mix, shingle_set

SIGNATURE, ROWS = 128, 4
BANDS = SIGNATURE // ROWS
PERCENT = 75
#: A pair is dropped unverified if more sketch bits differ. At a similarity of 0.75, 16 differ on average, by 3.7; more than 44 do for 1 pair in 10^10.
SKETCH_BITS = 44
CHUNK = 64
_STEPS = np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def superminhash(shingles: np.ndarray, size: int = SIGNATURE) -> np.ndarray:
    """Signature of a set of 64-bit hashes: rank in the upper 8 bits, the uniform part below. Bounded memory: 8192 shingles at a time."""
    out = np.full(size, _LAST)
    for start in range(0, len(shingles), 8192):
        x = shingles[start : start + 8192]
        at = np.arange(len(x))
        slots = np.tile(np.arange(size, dtype=np.uint8), (len(x), 1))
        for rank in range(size):
            if out.max() < np.uint64(rank << 56):
                break
            r = mix(x + _STEPS[rank])
            k = rank + ((r >> np.uint64(32)) * np.uint64(size - rank) >> np.uint64(32)).astype(np.int64)
            slot = slots[at, k]
            slots[at, k] = slots[at, rank]
            np.minimum.at(out, slot, np.uint64(rank << 56) | (mix(r) >> np.uint64(8)))
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    Remembered.begin("shingles")
    odd = mix(_STEPS[:ROWS]) | np.uint64(1)
    bands = mix(np.arange(BANDS, dtype=np.uint64))
    for batch in slices(batches, 1):
        n, sizes = batch.num_rows, np.zeros(batch.num_rows, np.int64)
        ids, keys, bits = np.zeros((n, 2), np.int64), np.zeros((n, BANDS), np.int64), np.zeros((n, SIGNATURE // 64), np.int64)
        for i, text in enumerate(batch.column("text")):
            s = shingle_set(text.as_py())
            if not len(s):
                continue
            sizes[i] = len(s)
            ids[i] = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
            signature = superminhash(s)
            keys[i] = mix((signature.reshape(BANDS, ROWS) * odd).sum(axis=1, dtype=np.uint64) ^ bands).view(np.int64)
            bits[i] = np.packbits((mix(signature) & np.uint64(1)).astype(np.uint8)).view(np.int64)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
        columns = [*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(sizes), *(pa.array(np.ascontiguousarray(c)) for c in (*ids.T, *bits.T)), listed]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "n_shingles", "h1", "h2", "s0", "s1", "bands"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, a, b, text), a cell's texts (b null) before its pairs -> (a, b, shared, total) shingles of each pair. Only one cell's sets are held."""
    Remembered.begin("shingles")
    cell, held = None, {}
    for batch in batches:
        found = []
        for key, a, b, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
            if key != cell:
                cell, held = key, {}
            if b is None:
                held[a] = shingle_set(text.as_py())
            else:
                x, y = held[a], held[b]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                found.append((a, b, shared, len(x) + len(y) - shared))
        columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "shared", "total"])


def _alike(a: str, b: str):
    """What a pair needs before its sets are read: sizes that allow the similarity, and a sketch that doesn't contradict it."""
    differ = sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(SIGNATURE // 64)), F.lit(0))
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (differ <= SKETCH_BITS) & (F.least(x, y) * 100 >= F.greatest(x, y) * PERCENT)


def _row_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that tell rows of different ids or texts apart; never null."""
    return F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(1), text, doc_id).alias("k2")


def _texts_of(ids: DataFrame, id: str, facts: DataFrame, texts: DataFrame) -> DataFrame:
    """ids with the text of each class's representative."""
    keys = facts.select(F.col("rep").alias(id), "k1", "k2")
    return ids.join(keys, id).join(texts.select("k1", "k2", "text"), ["k1", "k2"]).drop("k1", "k2")


def _cells(pairs: DataFrame) -> DataFrame:
    """(cell, a, b) of different pairs (g, a, b).

    A group's documents, on either side of its pairs, are dealt into chunks, and its pairs into cells of two chunks, so
    that a text travels once for each cell, not for each pair, and a cell holds 2 * CHUNK sets on average, however large
    the group.
    """
    chunks = pairs.select("g", F.explode(F.array("a", "b")).alias("id")).groupBy("g").agg(F.ceil(F.count_distinct("id") / CHUNK).alias("n"))
    of = lambda c: F.pmod(F.xxhash64(c), F.col("n"))
    return pairs.join(materialize(chunks, "chunks"), "g").select(F.xxhash64("g", F.least(of("a"), of("b")), F.greatest(of("a"), of("b"))).alias("cell"), "a", "b")


def _compare(pairs: DataFrame, facts: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, shared, total) of different pairs (g, a, b), from full sets."""
    cells = _cells(pairs)
    members = cells.select("cell", F.explode(F.array("a", "b")).alias("a")).distinct()
    read = _texts_of(members, "a", facts, texts).select("cell", "a", F.lit(None).cast("long").alias("b"), "text")
    rows = read.union(cells.select("cell", "a", "b", F.lit(None).cast("binary")))
    rows = rows.repartition("cell").sortWithinPartitions("cell", F.col("b").isNotNull())
    return to_python(rows).mapInArrow(_compared, "a long, b long, shared long, total long")


def _similar():
    return F.col("shared") * 100 >= F.col("total") * PERCENT


def _unsettled(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, id, lead, component) of the buckets whose members, the leader aside (it was compared with all), are of several components."""
    marked = buckets.filter("id <> lead").join(parts, "id", "left").select("key", "id", "lead", F.coalesce("component", "id").alias("component"))
    marked = materialize(marked, "marked")
    still = marked.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return materialize(_of_keys(marked, still.select("key")), "unsettled")


def _of_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows of the aggregated keys. These are a table by then, so that the join is of two plain exchanges, and a large bucket's partition can be split."""
    return rows.join(materialize(keys, "keys"), "key")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    Remembered.begin("shingles")
    for batch in slices(batches, 1):
        sets = [shingle_set(t.as_py()).view(np.int64) for t in batch.column(1)]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "shingles"])


def _prefix_pairs(unsettled: DataFrame, facts: DataFrame, texts: DataFrame) -> DataFrame:
    """(g, a, b): every pair of unsettled documents of different components that can be similar.

    Exact prefix filter: with shingles in one order for all, rarest first, two sets of size n and m that share 75 of 100
    have a shingle in common among the first n - ceil(0.75 n) + 1 and m - ceil(0.75 m) + 1, and the first that they share
    stands early enough for the rest to suffice. Copies with many edits of their own have those first, so a large group
    of loose copies gives few pairs. In each shingle's list the largest component is compared with the others only.
    """
    ids = materialize(unsettled.groupBy("id").agg(F.min("lead").alias("g"), F.min("component").alias("component")), "unsettled-ids")
    read = _texts_of(ids.select("id"), "id", facts, texts).select("id", "text").dropDuplicates(["id"])
    listed = materialize(to_python(read).mapInArrow(_listed, "id long, shingles array<long>"), "shingles")
    long = listed.select("id", F.explode("shingles").alias("s"))
    frequent = materialize(long.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1"), "frequent")
    n = F.size("shingles")
    sizes = listed.select("id", (n - F.ceil(n * PERCENT / 100) + 1).alias("prefix"), n.alias("n"))
    # Shingles of one document only come first and pair nothing: they only use up the prefix.
    shared = long.join(frequent, "s")
    rank, alone = F.row_number().over(W.partitionBy("id").orderBy("df", "s")), F.col("n") - F.count("*").over(W.partitionBy("id"))
    tokens = shared.join(sizes, "id").withColumn("rank", rank).withColumn("alone", alone).filter("rank + alone <= prefix").select("s", "id", (F.col("n") - F.col("rank") - F.col("alone")).alias("after"))
    tokens = tokens.join(ids, "id")
    tokens = materialize(tokens, "prefixes")
    parts = tokens.groupBy("s", "component").agg(F.count("*").alias("k"))
    largest = parts.groupBy("s").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), F.count("*").alias("c")).filter("c > 1").drop("c")
    tokens = materialize(tokens.join(materialize(largest, "largest"), "s").join(facts.withColumnRenamed("rep", "id").drop("k1", "k2"), "id"), "tokens")
    x, y = tokens.filter("component <> largest").alias("x"), tokens.alias("y")
    once = (F.col("y.component") == F.col("y.largest")) | (F.col("x.id") < F.col("y.id"))
    # If this is the first shingle they share, they share as many more as come after it at most; J >= t asks for t / (1 + t) of both sizes.
    enough = (F.least("x.after", "y.after") + 1) * (100 + PERCENT) >= (F.col("x.n_shingles") + F.col("y.n_shingles")) * PERCENT
    cross = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.component") != F.col("y.component")) & once & enough & _alike("x", "y"))
    pairs = cross.groupBy(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).agg(F.min(F.least("x.g", "y.g")).alias("g"))
    return pairs.select("g", "a", "b")


def _rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, k1, k2), one row per row of docs; kept is true for the rows of one key in each component."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    texts = texts.select("*", *_row_keys(F.col("doc_id"), F.col("text")))
    schema = "doc_id long, k1 long, k2 long, n_shingles long, h1 long, h2 long, s0 long, s1 long, bands array<long>"
    described = materialize(to_python(texts).mapInArrow(_described, schema), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")
    classes = described.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min(row).alias("first"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = described.join(classes, ["h1", "h2"]).filter("k1 = first.k1 AND k2 = first.k2")
    reps = materialize(reps.select("rep", "k1", "k2", "n_shingles", "s0", "s1", "bands").dropDuplicates(["rep"]), "representatives")
    facts = reps.drop("bands")

    buckets = reps.select(F.explode("bands").alias("key"), F.col("rep").alias("id"))
    shared = buckets.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("k")).filter("k > 1").drop("k")
    buckets = materialize(_of_keys(buckets, shared), "buckets")

    def star(members: DataFrame) -> DataFrame:
        """Each bucket's leader with its members, once for each different pair, where sizes and sketches admit it."""
        pairs = members.filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
        pairs = pairs.join(facts.alias("x"), F.col("a") == F.col("x.rep")).join(facts.alias("y"), F.col("b") == F.col("y.rep"))
        return pairs.filter(_alike("x", "y")).select(F.col("a").alias("g"), "a", "b")

    known = materialize(_compare(star(buckets), facts, texts), "compared")
    parts = materialize(connected_components(known.filter(_similar()).select("a", "b")), "components")
    unsettled = _unsettled(buckets, parts)
    if not unsettled.isEmpty():
        likeness = known.select(F.col("a").alias("lead"), F.col("b").alias("id"), (F.col("shared") / F.col("total")).alias("j"))
        central = unsettled.join(likeness, ["lead", "id"]).groupBy("key").agg(F.max_by(F.struct("id", "component"), F.struct("j", "id")).alias("c"))
        again = _of_keys(unsettled.drop("lead"), central).filter("component <> c.component").select("key", "id", F.col("c.id").alias("lead"))
        fresh = materialize(star(again).withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")}).dropDuplicates(["a", "b"]).join(known, ["a", "b"], "left_anti").select("g", "a", "b"), "pairs")
        known = known.union(materialize(_compare(fresh, facts, texts), "compared"))
        parts = materialize(connected_components(known.filter(_similar()).select("a", "b")), "components")
        unsettled = _unsettled(buckets, parts)
        if not unsettled.isEmpty():
            pairs = materialize(_prefix_pairs(unsettled, facts, texts).join(known, ["a", "b"], "left_anti").select("g", "a", "b"), "pairs")
            known = known.union(materialize(_compare(pairs, facts, texts), "compared"))
            parts = connected_components(known.filter(_similar()).select("a", "b"))
    named = parts.join(classes.select(F.col("rep").alias("id"), "first"), "id").groupBy("component").agg(F.min("first").alias("top"))
    parts = parts.join(named, "component").select("id", "top")
    out = described.select("doc_id", "n_shingles", "k1", "k2", "h1", "h2").join(classes, ["h1", "h2"], "left").join(parts, F.col("rep") == F.col("id"), "left")
    alone = F.col("n_shingles") == 0
    out = out.withColumn("top", F.coalesce("top", "first"))
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id"))
    kept = alone | ((F.col("k1") == F.col("top.k1")) & (F.col("k2") == F.col("top.k2")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "k1", "k2")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs."""
    return _rows(docs, text, doc_id).drop("k1", "k2")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each component. Rows without a shingle all stay."""
    k1, k2, alone, row = unused(docs, "k1", "k2", "alone", "row")
    kept = _rows(docs).filter("kept").select(F.col("k1").alias(k1), F.col("k2").alias(k2), (F.col("n_shingles") == 0).alias(alone)).distinct()
    own = _row_keys(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    rows = docs.withColumns(dict(zip((k1, k2), own, strict=True))).join(kept, [k1, k2])
    rows = rows.withColumn(row, F.when(F.col(alone), F.monotonically_increasing_id()))
    return rows.dropDuplicates([k1, k2, row]).select(*quoted(*docs.columns))
