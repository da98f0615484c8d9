"""Sharding by minimax contiguous partition.

Equal texts form an atomic group. Groups are ordered by the MD5 of their text, and that order is cut into N contiguous
shards whose largest is as small as it can be: a binary search over the capacity, with a greedy walk as its check. The
walk needs the running sums only near the places where a cut can fall. So the driver reads sums of parts of the order
(16 ** ROOT_DIGITS), then of ever finer parts of those that may hold a cut, until these are single groups: some ten
thousand numbers in each of a few rounds, whatever the number of groups. A document finds its shard by comparing its
hash with the cuts: no join, no shuffle of texts.

Defined results: a null text counts as empty (size 1, CRC-32 0) and shares the empty texts' group; repeated rows and
null ids are documents like others; an empty table gives an empty result; if one group outweighs an even share, its
shard is that large and the others stay minimal around it; trailing shards may then be empty; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

LAW = "bytes"
SHARDS = 8
ROOT_DIGITS, FINER_DIGITS = 3, 2
ROWS_PER_CELL = 50_000


def _walk(sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """Greedy check: the running sums at which shards end, or None if they don't suffice."""
    ends, at = [], 0
    while at < sums[-1]:
        if len(ends) == shards:
            return None
        end = sums[bisect_right(sums, at + capacity) - 1]
        if end <= at:
            return None
        ends.append(at := end)
    return ends


def _smallest(sums: list[int], low: int, high: int, shards: int) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _walk(sums, middle, shards) else (middle + 1, high)
    return low


def _parts(groups: DataFrame, prefixes: list[str], digits: int) -> list[tuple[str, int, int, str]]:
    """(prefix, size, groups, last hash) of the parts by so many digits below the prefixes, in order."""
    if prefixes:
        groups = groups.filter(F.substring("h", 1, len(prefixes[0])).isin(prefixes))
    parts = groups.groupBy(F.substring("h", 1, digits).alias("p")).agg(F.sum("group_size").alias("s"), F.count("*").alias("n"), F.max("h").alias("h"))
    return [(r["p"], r["s"], r["n"], r["h"]) for r in parts.orderBy("p").collect()]


def minimax_cuts(groups: DataFrame, shards: int = SHARDS) -> list[str]:
    """groups: (h, group_size), h in hexadecimal digits and different. The largest h of every shard but the last non-empty one.

    In each round, parts are taken as a whole: what is feasible then is feasible, so it bounds the capacity from above,
    and walks that stop before a part that doesn't fit whole bound each cut from below. Parts between the bounds of a cut
    are divided further. When all of them are single groups, the search among them is exact.
    """
    parts = _parts(groups, [], ROOT_DIGITS)
    if not parts:
        return []
    largest = groups.agg(F.max("group_size")).first()[0]
    while True:
        ends = [0, *accumulate(p[1] for p in parts)]
        low = max(-(-ends[-1] // shards), largest)
        high = _smallest(ends, low, ends[-1], shards)
        divide, below, above = set(), 0, 0
        for _ in range(shards):
            below, above = ends[bisect_right(ends, below + low) - 1], min(above + high, ends[-1])
            first, last = bisect_right(ends, below) - 1, bisect_right(ends, above) - 1
            divide |= {i for i in range(first, min(last + 1, len(parts))) if parts[i][2] > 1}
        if not divide:
            names = dict(zip(ends[1:], (p[3] for p in parts), strict=True))
            return [names[end] for end in _walk(ends, high, shards)[:-1]]
        # Parts of one length are divided by one query.
        finer: dict[str, list] = {}
        for digits in {len(parts[i][0]) for i in divide}:
            for p in _parts(groups, [parts[i][0] for i in divide if len(parts[i][0]) == digits], digits + FINER_DIGITS):
                finer.setdefault(p[0][:digits], []).append(p)
        parts = [x for i, p in enumerate(parts) for x in (finer[p[0]] if i in divide else [p])]


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row per row of docs."""
    body = common.text_or_empty(text)
    rows = common.materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body).cast("long") + 1).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.md5(body.cast("binary")).alias("h"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("h").agg(F.sum("size").alias("group_size"))
    groups = groups.repartitionByRange("h").sortWithinPartitions("h")
    groups = common.materialize(groups, "shard-groups")  # sorted files: a look into a few parts skips the others
    cuts = minimax_cuts(groups, shards)
    number = sum(((F.col("h") > cut).cast("int") for cut in cuts), F.lit(0))

    # Slots: cells of each shard are numbered inside, then offset by the cells before; a cell takes its rows by their place in the table, so copies spread.
    n_cells = max(1, rows.count() // ROWS_PER_CELL // shards + 1)
    rows = rows.withColumn("shard", number).withColumn("cell", F.pmod(F.xxhash64("at"), F.lit(n_cells)))
    cells = common.sums_before(rows.groupBy("shard", "cell").agg(F.count("*").alias("n")), ["shard"], "cell", "n", "before").drop("n")
    place = F.row_number().over(W.partitionBy("shard", "cell").orderBy("doc_id", "h", "at"))
    rows = rows.withColumn("place", place).join(cells, ["shard", "cell"])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
