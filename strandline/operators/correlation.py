"""Pairwise-complete correlation, its stability over thirds, and redundancy pruning."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks

#: Columns of a tile of pairs.
TILE = 512
#: A side whose sum of squares about the mean is so small a share of the sum about the shift is constant but for rounding.
ROUNDING = 1e-13
#: Edges that an election reads; more mean that whole families are copies of each other.
MAX_EDGES = 2_000_000


@dataclass(frozen=True)
class Thresholds:
    full: float
    third: float
    full_support: int = 30
    third_support: int = 10


FAMILY = Thresholds(0.995, 0.99)
GLOBAL = Thresholds(0.95, 0.90)


def pairs(panel: DataFrame, families: Mapping[str, Iterable[str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """(family, left, right, x, y, *keep) of every pair of features of a family, per row.

    Pairs are made inside a row (a feature with those after it), so nothing is joined; the aggregation that follows
    combines in each task, and what is shuffled are pairs, not rows.
    """
    entry = lambda f: F.struct(F.lit(f).alias("f"), F.col(f).alias("v"))
    groups = F.array(*[F.struct(F.lit(name).alias("family"), F.array(*[entry(f) for f in fs]).alias("e")) for name, fs in families.items()])
    rows = panel.select(*keep, F.explode(groups).alias("g"))
    rows = rows.select(*keep, "g.family", F.col("g.e").alias("e"), F.posexplode("g.e").alias("i", "a")).filter("a.v IS NOT NULL")
    rows = rows.select(*keep, "family", "a", F.explode(F.slice("e", F.col("i") + 2, F.greatest(F.size("e") - F.col("i") - 1, F.lit(0)))).alias("b"))
    rows = rows.filter("b.v IS NOT NULL")
    return rows.select(*keep, "family", F.col("a.f").alias("left"), F.col("b.f").alias("right"), F.col("a.v").alias("x"), F.col("b.v").alias("y"))


def abs_corr(x: str = "x", y: str = "y") -> Column:
    """NULL for fewer than two rows or a constant side, where corr() would fail."""
    product = F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))
    return F.when(F.count("*") >= 2, F.abs(F.try_divide(F.regr_sxy(y, x), product)))


def thirds(panel: DataFrame, time: str = "ts") -> DataFrame:
    """panel with third (1 to 3): contiguous, remainder to the first. Only times are ranked in one task; rows get their third by two bounds."""
    ranked = panel.select(time).select(time, F.ntile(3).over(W.orderBy(time)).alias("third"))
    bounds = ranked.groupBy().agg(F.min(F.when(F.col("third") == 2, F.col(time))).alias("b2"), F.min(F.when(F.col("third") == 3, F.col(time))).alias("b3"))
    third = F.when(F.col(time) >= F.col("b3"), 3).when(F.col(time) >= F.col("b2"), 2).otherwise(1)
    return panel.crossJoin(F.broadcast(bounds)).withColumn("third", third.cast("long")).drop("b2", "b3")  # bounds is one row


def _tiled(panel: DataFrame, families: Mapping[str, Iterable[str]], limits: Thresholds | None, time: str | None) -> DataFrame:
    """(family, left, right, full_corr, full_support, corr_1..3, support_1..3) of the pairs that have a row, or of those that pass the limits.

    Six sums of a pair (rows, both sums, both sums of squares, products) over the rows where both sides are present are
    matrix products of a tile's columns and their masks; without NULL in a block of rows, only the products are. Without
    a time there are no thirds.
    """
    names = {name: list(fs) for name, fs in families.items()}
    features = list(dict.fromkeys(f for fs in names.values() for f in fs))
    at = {f: k for k, f in enumerate(features)}
    tiles = []
    for name, fs in names.items():
        cuts = [fs[k : k + TILE] for k in range(0, len(fs), TILE)]
        tiles += [(name, a, b, j == k) for j, a in enumerate(cuts) for k, b in enumerate(cuts) if j <= k]
    places = [(np.array([at[f] for f in a]), np.array([at[f] for f in b])) for _, a, b, _ in tiles]
    rows = blocks.packed(panel, features, () if time is None else (time,))
    if time is not None:
        rows = thirds(rows, time)

    def partial(labels: np.ndarray, x: np.ndarray, wanted: Iterable[int]) -> Iterator[tuple[int, int, np.ndarray]]:
        parts = [(int(label), labels == label) for label in np.unique(labels)]
        for tile in wanted:
            i, j = places[tile]
            left, right = x[:, i], x[:, j]
            for label, own in parts:
                a, b = left[own], right[own]
                m, n = np.isfinite(a), np.isfinite(b)
                if m.all() and n.all():
                    vectors = [a.sum(axis=0), b.sum(axis=0), (a * a).sum(axis=0), (b * b).sum(axis=0)]
                    yield tile, 2 * label, np.concatenate([[len(a)], *vectors, (a.T @ b).ravel()])
                else:
                    a, b, m, n = np.where(m, a, 0.0), np.where(n, b, 0.0), m.astype(float), n.astype(float)
                    yield tile, 2 * label + 1, np.concatenate([p.ravel() for p in (m.T @ n, a.T @ n, m.T @ b, (a * a).T @ n, m.T @ (b * b), a.T @ b)])

    def final(tile: int, parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple]:
        name, left, right, diagonal = tiles[tile]
        p, q = len(left), len(right)
        sums = np.zeros((4, 6, p, q))
        for kind, s in parts:
            own = sums[kind // 2]
            if kind % 2:
                own += s.reshape(6, p, q)
            else:
                vectors = np.split(s[1 : 1 + 2 * (p + q)], [p, p + q, 2 * p + q])
                own[0] += s[0]
                for k, v in zip((1, 2, 3, 4), vectors, strict=True):
                    own[k] += v[:, None] if k % 2 else v[None, :]
                own[5] += s[1 + 2 * (p + q) :].reshape(p, q)
        sums[0] += sums[1:].sum(axis=0)
        n = sums[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            xx, yy, xy = (sums[:, 3] - sums[:, 1] ** 2 / n, sums[:, 4] - sums[:, 2] ** 2 / n, sums[:, 5] - sums[:, 1] * sums[:, 2] / n)
            corr = np.where((n >= 2) & (xx > ROUNDING * sums[:, 3]) & (yy > ROUNDING * sums[:, 4]), np.minimum(np.abs(xy) / np.sqrt(xx * yy), 1.0), np.nan)
        wanted = n[0] > 0
        if limits is not None:
            wanted &= (corr[0] >= limits.full) & (n[0] >= limits.full_support)
            for k in (1, 2, 3):
                wanted &= (corr[k] >= limits.third) & (n[k] >= limits.third_support)
        if diagonal:
            wanted &= np.triu(np.ones((p, q), bool), 1)
        for i, j in zip(*np.nonzero(wanted), strict=True):
            c = [None if np.isnan(v) else float(v) for v in corr[:, i, j]]
            yield name, left[i], right[j], c[0], int(n[0, i, j]), *c[1:], *(int(v) for v in n[1:, i, j])

    corrs, supports = [f"corr_{k}" for k in (1, 2, 3)], [f"support_{k}" for k in (1, 2, 3)]
    columns = ["family", "left", "right", "full_corr", "full_support", *corrs, *supports]
    types = [pa.string()] * 3 + [pa.float64(), pa.int64()] + [pa.float64()] * 3 + [pa.int64()] * 3
    sql = {pa.string(): "string", pa.float64(): "double", pa.int64(): "long"}
    schema = ", ".join(f"`{c}` {sql[t]}" for c, t in zip(columns, types, strict=True))
    return blocks.summed(rows, F.lit(0) if time is None else F.col("third"), len(features), len(tiles), partial, final, columns, types, schema)[0]


def pair_correlations(panel: DataFrame, families: Mapping[str, Iterable[str]]) -> DataFrame:
    return _tiled(panel, families, None, None).select("family", "left", "right", F.col("full_corr").alias("abs_corr"), F.col("full_support").alias("support"))


def third_correlations(panel: DataFrame, families: Mapping[str, Iterable[str]], time: str = "ts") -> DataFrame:
    rows = _tiled(panel, families, None, time)
    one = lambda k: F.struct(F.lit(k).cast("long").alias("third"), F.col(f"corr_{k}").alias("abs_corr"), F.col(f"support_{k}").alias("support"))
    return rows.select("family", "left", "right", F.explode(F.array(*[one(k) for k in (1, 2, 3)])).alias("t")).select("family", "left", "right", "t.*").filter("support > 0")


def stable_edges(panel: DataFrame, families: Mapping[str, Iterable[str]], limits: Thresholds, time: str = "ts") -> DataFrame:
    """(family, left, right, full_corr, full_support, corr_1..3, support_1..3) of pairs redundant in the full window and in each third.

    One pass over the rows; sums of the thirds make those of the whole.
    """
    return _tiled(panel, families, limits, time)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, median_corr) over both ends of every edge."""
    both = edges.select(F.col("left").alias("node"), "full_corr").unionByName(edges.select(F.col("right").alias("node"), "full_corr"))
    return both.groupBy("node").agg(F.count("*").alias("degree"), F.median("full_corr").alias("median_corr"))


@dataclass(frozen=True)
class Election:
    representatives: tuple[str, ...]
    removed: dict[str, str]  # feature -> its representative
    edges: dict[tuple[str, str], dict] = field(default_factory=dict, compare=False)  # (removed, representative) -> the stable edge between them


def _median(values: list[float]) -> float:
    values, h = sorted(values), len(values) // 2
    return 0.0 if not values else values[h] if len(values) % 2 else (values[h - 1] + values[h]) / 2


def elect_leaders(edges: Iterable[tuple[str, str, float]], features: Mapping[str, tuple]) -> Election:
    """Greedy: the feature with most remaining redundant partners, then the higher median correlation, then the smaller key, leads and removes its direct partners.

    edges: (left, right, corr). features: each feature's own tie-break key, smaller first (for families: -coverage, name;
    across families: is_pc, ordinal, name). Only partners of what was removed are looked at again.
    """
    near: dict[str, dict[str, float]] = {f: {} for f in features}
    for a, b, corr in edges:
        near[a][b] = near[b][a] = corr
    rank = lambda f: (-len(near[f]), -_median(list(near[f].values())), *features[f])
    linked, leaders, removed = {f: rank(f) for f in features if near[f]}, [], {}
    while linked:
        best = min(linked, key=linked.get)
        leaders.append(best)
        gone = [*near[best], best]
        touched = set()
        for g in gone:
            if g != best:
                removed[g] = best
            linked.pop(g, None)
            touched |= near[g].keys()
        for f in touched.difference(gone):
            for g in gone:
                near[f].pop(g, None)
            if near[f]:
                linked[f] = rank(f)
            else:
                linked.pop(f, None)
        for g in gone:
            near[g] = {}
    done = {*leaders, *removed}
    return Election((*leaders, *sorted((f for f in features if f not in done), key=rank)), removed)


def prune(panel: DataFrame, families: Mapping[str, Iterable[str]], limits: Thresholds, key=None, time: str = "ts") -> dict[str, Election]:
    """Each family's election. Only its edges (MAX_EDGES, which is checked) and names come to the driver."""
    key = key or (lambda f: (f,))
    families = {name: list(fs) for name, fs in families.items()}
    found = stable_edges(panel, families, limits, time).limit(MAX_EDGES + 1).collect()
    if len(found) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} stable edges: families are copies of each other")
    edges: dict[str, dict] = {name: {} for name in families}
    for r in found:
        edges[r["family"]][r["left"], r["right"]] = r
    out = {}
    for name, fs in families.items():
        e = elect_leaders([(a, b, r["full_corr"]) for (a, b), r in edges[name].items()], {f: key(f) for f in fs})
        between = {(f, lead): (edges[name].get((f, lead)) or edges[name][lead, f]).asDict() for f, lead in e.removed.items()}
        out[name] = Election(e.representatives, e.removed, between)
    return out


def average_ranks(values: np.ndarray) -> np.ndarray:
    """Ranks from 1, those of equal values averaged."""
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[inverse]


def spearman_distance(panel: DataFrame, families: Mapping[str, Iterable[str]]) -> DataFrame:
    """(left, right, distance, support): 1 - |Pearson of average ranks| over pairwise-complete rows.

    A panel of blocks.SMALL_BYTES at most, which is checked, is broadcast; a task takes the pairs of a feature, and ranks again only for pairs
    with NULL. Of a larger one every pair is ranked by a window.
    """
    names = {name: list(fs) for name, fs in families.items()}
    features = list(dict.fromkeys(f for fs in names.values() for f in fs))
    _, x, whole = blocks.head(blocks.packed(panel, features), F.lit(0), len(features))
    if not whole:
        return _spearman_by_windows(panel, families)
    at = {f: k for k, f in enumerate(features)}
    jobs = [(f, fs[k + 1 :]) for fs in names.values() for k, f in enumerate(fs[:-1])]
    spark = panel.sparkSession
    shipped = spark.sparkContext.broadcast(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shipped.value
        there = np.isfinite(x)
        once: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for left, rest in (jobs[k] for k in batch.column(0).to_pylist()):
                i = at[left]
                for right in rest:
                    j = at[right]
                    both = there[:, i] & there[:, j]
                    n = int(both.sum())
                    if not n:
                        continue
                    if n == len(x):
                        u, v = (once.setdefault(c, average_ranks(x[:, c])) if c not in once else once[c] for c in (i, j))
                    else:
                        u, v = average_ranks(x[both, i]), average_ranks(x[both, j])
                    u, v = u - u.mean(), v - v.mean()
                    scale = float(np.sqrt((u @ u) * (v @ v)))
                    out.append((left, right, None if n < 2 or not scale else 1 - abs(float(u @ v)) / scale, n))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.int64()))], ["left", "right", "distance", "support"])

    tasks = spark.range(0, len(jobs), 1, max(1, min(len(jobs), 2 * spark.sparkContext.defaultParallelism)))
    return tasks.mapInArrow(run, "`left` string, `right` string, distance double, support long")


def _spearman_by_windows(panel: DataFrame, families: Mapping[str, Iterable[str]]) -> DataFrame:
    rows = pairs(panel, families)

    def average_rank(c: str) -> Column:
        pair = ["left", "right"]
        ties = F.count("*").over(W.partitionBy(*pair, c)) - 1
        return F.rank().over(W.partitionBy(*pair).orderBy(c)) + ties / 2

    ranked = rows.select("left", "right", average_rank("x").alias("x"), average_rank("y").alias("y"))
    return ranked.groupBy("left", "right").agg((1 - abs_corr()).alias("distance"), F.count("*").alias("support"))


def silhouette(points: DataFrame, features: list[str], node: str, cluster: str) -> DataFrame:
    """(cluster_count, silhouette): mean over points of (b - a) / max(a, b) with Euclidean distances; singletons count 0.

    Distances to a cluster's points are averaged pair by pair, as the definition asks; the clusters compared are feature
    clusters (hundreds of points), so the points are checked to be few and are joined as a broadcast.
    """
    rows = points.select(F.col(node).alias("n"), F.col(cluster).alias("c"), F.array(*features).alias("v"))
    if rows.limit(20_001).count() > 20_000:
        raise ValueError("silhouette: more than 20000 points")
    a, b = rows.alias("a"), F.broadcast(rows.alias("b"))
    squares = F.zip_with("a.v", "b.v", lambda x, y: (x - y) * (x - y))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))
    means = a.join(b, F.col("a.n") != F.col("b.n")).groupBy(F.col("a.n").alias("n"), F.col("a.c").alias("c"), F.col("b.c").alias("other")).agg(F.avg(distance).alias("d"))
    per = means.groupBy("n", "c").agg(F.max(F.when(F.col("c") == F.col("other"), F.col("d"))).alias("own"), F.min(F.when(F.col("c") != F.col("other"), F.col("d"))).alias("near"))
    value = F.coalesce((F.col("near") - F.col("own")) / F.greatest("near", "own"), F.lit(0.0))
    return per.agg(F.count_distinct("c").alias("cluster_count"), F.avg(value).alias("silhouette"))
