"""Queries of correlation, redundancy, probabilities and information."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import correlation, diagnostics, quality
from ..sources import panels
from .catalogue import query
from .oracle_panels import EMBEDDING_MATRIX, EVENTS_HOURLY, LINEITEM_DAILY, ORDERS_DAILY, PROB_PAIRS, with_panels

EVENTS = list(panels.EVENTS)
DIMENSIONS = [f"x{k:02d}" for k in range(1, panels.DIMENSIONS + 1)]
BLOCKS = {f"block_{b + 1}": DIMENSIONS[8 * b : 8 * b + 8] for b in range(8)}
#: Embedding columns are hardly correlated, so the thresholds of these two queries are lowered until edges exist.
BLOCK_LIMITS = correlation.Thresholds(0.02, 0.001)
ALL_LIMITS = correlation.Thresholds(0.05, 0.005)


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN regr_count({y}, {x}) >= 2 THEN abs(regr_sxy({y}, {x}) / nullif(sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x})), 0)) END"


def _pairs(names: list[str], relation: str, keep: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keep}'{a}' AS \"left\", '{b}' AS \"right\", {a} AS x, {b} AS y FROM {relation} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in combinations(names, 2))


@query(f'WITH {EVENTS_HOURLY}, p AS ({_pairs(EVENTS, "events_hourly")}) SELECT "left", "right", round({_corr("x", "y")}, 8) AS abs_corr, count(*) AS support FROM p GROUP BY 1, 2')
def q_pair_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = correlation.pair_correlations(panels.events_hourly(spark, sf_dir), {"events": EVENTS})
    return out.select("left", "right", F.round("abs_corr", 8).alias("abs_corr"), "support")


@query(
    f"WITH {EVENTS_HOURLY}, t AS (SELECT *, ntile(3) OVER (ORDER BY ts) AS third FROM events_hourly), p AS ({_pairs(EVENTS, 't', 'third, ')}) "
    f'SELECT "left", "right", third, round({_corr("x", "y")}, 8) AS abs_corr, count(*) AS support FROM p GROUP BY 1, 2, 3'
)
def q_pair_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = correlation.third_correlations(panels.events_hourly(spark, sf_dir), {"events": EVENTS})
    return out.select("left", "right", "third", F.round("abs_corr", 8).alias("abs_corr"), "support")


def _edges_sql(families: dict[str, list[str]], limits: correlation.Thresholds) -> str:
    table = ", ".join(f"('{f}', '{name}', {DIMENSIONS.index(f)})" for name, fs in families.items() for f in fs)
    parts = ", ".join(
        f"CASE WHEN regr_count(y, x) FILTER (WHERE third = {k}) >= 2 THEN abs(regr_sxy(y, x) FILTER (WHERE third = {k}) / nullif(sqrt((regr_sxx(y, x) FILTER (WHERE third = {k})) * (regr_syy(y, x) FILTER (WHERE third = {k}))), 0)) END AS corr_{k}, "
        f"count(*) FILTER (WHERE third = {k}) AS support_{k}"
        for k in (1, 2, 3)
    )
    tests = " AND ".join(f"corr_{k} >= {limits.third} AND support_{k} >= {limits.third_support}" for k in (1, 2, 3))
    return f"""{EMBEDDING_MATRIX}, t AS (SELECT *, ntile(3) OVER (ORDER BY vec_id) AS third FROM embedding_matrix),
u AS (UNPIVOT t ON {', '.join(DIMENSIONS)} INTO NAME f VALUE v), fam(f, family, o) AS (VALUES {table}),
w AS (SELECT u.*, fam.family, fam.o FROM u JOIN fam USING (f)),
p AS (SELECT a.family, a.f AS "left", b.f AS "right", a.third, a.v AS x, b.v AS y FROM w a JOIN w b ON a.vec_id = b.vec_id AND a.family = b.family AND a.o < b.o),
e AS (SELECT family, "left", "right", {_corr("x", "y")} AS full_corr, count(*) AS full_support, {parts} FROM p GROUP BY 1, 2, 3),
edges AS (SELECT * FROM e WHERE full_corr >= {limits.full} AND full_support >= {limits.full_support} AND {tests})"""


_EDGE_COLUMNS = ["full_corr", "corr_1", "corr_2", "corr_3"]
_EDGES_SELECT = 'SELECT family, "left", "right", ' + ", ".join(f"round({c}, 8) AS {c}" for c in _EDGE_COLUMNS) + ", full_support, support_1, support_2, support_3 FROM edges"


def _edges(spark: SparkSession, sf_dir: str, families: dict[str, list[str]], limits: correlation.Thresholds) -> DataFrame:
    return correlation.stable_edges(panels.embedding_matrix(spark, sf_dir), families, limits, "vec_id")


def _rounded(edges: DataFrame) -> DataFrame:
    return edges.select("family", "left", "right", *[F.round(c, 8).alias(c) for c in _EDGE_COLUMNS], "full_support", *[f"support_{k}" for k in (1, 2, 3)])


@query(f"WITH {_edges_sql(BLOCKS, BLOCK_LIMITS)} {_EDGES_SELECT}")
def q_family_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_edges(spark, sf_dir, BLOCKS, BLOCK_LIMITS))


_GLOBAL = _edges_sql({"all": DIMENSIONS}, ALL_LIMITS)
_BOTH = ', n AS (SELECT "left" AS node, full_corr FROM edges UNION ALL SELECT "right", full_corr FROM edges)'


@query(f"WITH {_GLOBAL} {_EDGES_SELECT}")
def q_global_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_edges(spark, sf_dir, {"all": DIMENSIONS}, ALL_LIMITS))


@query(f"WITH {_GLOBAL}{_BOTH} SELECT node, count(*) AS degree FROM n GROUP BY 1")
def q_edge_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.degrees(_edges(spark, sf_dir, {"all": DIMENSIONS}, ALL_LIMITS)).select("node", "degree")


@query(f"WITH {_GLOBAL}{_BOTH} SELECT node, round(median(full_corr), 8) AS median_corr FROM n GROUP BY 1")
def q_neighbour_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.degrees(_edges(spark, sf_dir, {"all": DIMENSIONS}, ALL_LIMITS)).select("node", F.round("median_corr", 8).alias("median_corr"))


@query()
def q_leader_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    election = correlation.prune(panels.embedding_matrix(spark, sf_dir), {"all": DIMENSIONS}, ALL_LIMITS, time="vec_id")["all"]
    rows = [(f, f, True) for f in election.representatives] + [(f, r, False) for f, r in election.removed.items()]
    return spark.createDataFrame(rows, "feature string, representative string, retained boolean")


@query(
    f"""WITH {EVENTS_HOURLY}, p AS ({_pairs(EVENTS, "events_hourly")}),
r AS (SELECT "left", "right", rank() OVER (PARTITION BY "left", "right" ORDER BY x) + (count(*) OVER (PARTITION BY "left", "right", x) - 1) / 2.0::DOUBLE AS x,
  rank() OVER (PARTITION BY "left", "right" ORDER BY y) + (count(*) OVER (PARTITION BY "left", "right", y) - 1) / 2.0::DOUBLE AS y FROM p)
SELECT "left", "right", round(1 - {_corr("x", "y")}, 8) AS distance, count(*) AS support FROM r GROUP BY 1, 2"""
)
def q_spearman_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = correlation.spearman_distance(panels.events_hourly(spark, sf_dir), {"events": EVENTS})
    return out.select("left", "right", F.round("distance", 8).alias("distance"), "support")


#: Points of the silhouette: the days' scaled means, clustered by quarter.
_POINTS = f"""{LINEITEM_DAILY}, o AS (SELECT ts, price, quantity FROM lineitem_daily WHERE price IS NOT NULL AND quantity IS NOT NULL),
m AS (SELECT strftime(ts, '%Y-%m') AS node, quarter(any_value(ts)) AS c, avg(price) / 10000 AS a, avg(quantity) AS b FROM o GROUP BY 1)"""


@query(
    f"""WITH {_POINTS}, d AS (SELECT x.node, x.c, y.c AS other, avg(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2)) AS d FROM m x JOIN m y ON x.node <> y.node GROUP BY 1, 2, 3),
s AS (SELECT node, c, max(d) FILTER (WHERE c = other) AS own, min(d) FILTER (WHERE c <> other) AS near FROM d GROUP BY 1, 2)
SELECT count(DISTINCT c) AS cluster_count, round(avg(coalesce((near - own) / greatest(near, own), 0)), 7) AS silhouette FROM s"""
)
def q_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = panels.lineitem_daily(spark, sf_dir).na.drop("any", subset=["price", "quantity"])
    months = days.groupBy(F.date_format("ts", "yyyy-MM").alias("node")).agg(F.quarter(F.min("ts")).alias("c"), (F.avg("price") / 10000).alias("a"), F.avg("quantity").alias("b"))
    out = correlation.silhouette(months, ["a", "b"], "node", "c")
    return out.select("cluster_count", F.round("silhouette", 7).alias("silhouette"))


def _entropy(p: str) -> str:
    return f"list_sum(list_transform({p}, lambda v: CASE WHEN v > 0 THEN -v * ln(v) ELSE 0 END))"


def _dominant(p: str) -> str:
    return f"(list_position({p}, list_max({p})) - 1)::BIGINT"


@query(f"WITH {PROB_PAIRS} SELECT ts, round(list_max(p), 9) AS confidence, round({_entropy('p')}, 9) AS entropy, list_max(p) < 0.6 AS low_confidence, {_dominant('p')} AS dominant FROM prob_pairs")
def q_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.uncertainty(panels.prob_pairs(spark, sf_dir))
    return out.select("ts", F.round("confidence", 9).alias("confidence"), F.round("entropy", 9).alias("entropy"), "low_confidence", F.col("dominant").cast("long").alias("dominant"))


@query(
    f"WITH {PROB_PAIRS}, e AS (SELECT {_dominant('p')} AS d, unnest(range(3)) AS state, unnest(p) AS v FROM prob_pairs) "
    "SELECT state::BIGINT AS state, round(avg((d = state)::INT), 9) AS hard, round(avg(v), 9) AS soft FROM e GROUP BY 1"
)
def q_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.occupancy(panels.prob_pairs(spark, sf_dir))
    return out.select("state", F.round("hard", 9).alias("hard"), F.round("soft", 9).alias("soft"))


_RUNS = f"""{PROB_PAIRS}, s AS (SELECT ts, {_dominant('p')} AS state FROM prob_pairs), c AS (SELECT *, CASE WHEN state = lag(state) OVER (ORDER BY ts) THEN 0 ELSE 1 END AS c FROM s)"""


@query(f"WITH {_RUNS}, r AS (SELECT state, sum(c) OVER (ORDER BY ts)::BIGINT AS run FROM c) SELECT run, state, count(*) AS length FROM r GROUP BY 1, 2")
def q_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.durations(panels.prob_pairs(spark, sf_dir))


@query(
    f"WITH {_RUNS}, a AS (SELECT (sum(c) - 1)::BIGINT AS switches, date_diff('day', min(ts), max(ts))::DOUBLE AS days FROM c) SELECT switches, days, round(switches * 365.2425 / days, 8) AS per_year FROM a"
)
def q_switch_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.switch_rate(panels.prob_pairs(spark, sf_dir))
    return out.select("switches", "days", F.round("per_year", 8).alias("per_year"))


@query(
    f"""WITH {PROB_PAIRS}, a AS (SELECT ts, q, unnest(range(3)) AS k, unnest(p) AS a FROM prob_pairs), b AS (SELECT k, a, unnest(range(3)) AS l, unnest(q) AS b FROM a),
j AS (SELECT k, l, sum(a * b) / (SELECT count(*) FROM prob_pairs) AS m FROM b GROUP BY 1, 2), r AS (SELECT k, sum(m) AS r FROM j GROUP BY 1), c AS (SELECT l, sum(m) AS c FROM j GROUP BY 1)
SELECT round((SELECT sum(CASE WHEN m > 0 THEN m * ln(m / (r * c)) ELSE 0 END) FROM j JOIN r USING (k) JOIN c USING (l)) / sqrt((SELECT sum(CASE WHEN r > 0 THEN -r * ln(r) ELSE 0 END) FROM r) * (SELECT sum(CASE WHEN c > 0 THEN -c * ln(c) ELSE 0 END) FROM c)), 9) AS nmi,
  (SELECT count(*) FROM prob_pairs) AS shared"""
)
def q_soft_nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.soft_nmi(panels.prob_pairs(spark, sf_dir)).select(F.round("nmi", 9).alias("nmi"), "shared")


@query(f"WITH {ORDERS_DAILY}, {LINEITEM_DAILY} SELECT count(o.ts) AS shared, count(*) AS total, round(count(o.ts) / count(*)::DOUBLE, 9) AS coverage FROM lineitem_daily l LEFT JOIN orders_daily o USING (ts)")
def q_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.support(panels.orders_daily(spark, sf_dir), panels.lineitem_daily(spark, sf_dir))
    return out.select("shared", "total", F.round("coverage", 9).alias("coverage"))


NAMES = ["price", "discount", "tax", "quantity"]
_LONG = f"{LINEITEM_DAILY}, {PROB_PAIRS}, l AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, {n} AS x, p FROM lineitem_daily JOIN prob_pairs USING (ts) WHERE {n} IS NOT NULL" for n in NAMES) + ")"


@query(
    f"""WITH {_LONG}, r AS (SELECT feature, p, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY feature) AS n FROM l),
b AS (SELECT feature, n, least(9, floor(10 * (r - 1) / n)) AS bin, unnest(range(3)) AS k, unnest(p) AS v FROM r), m AS (SELECT feature, bin, k, sum(v) / max(n) AS m, max(n) AS n FROM b GROUP BY 1, 2, 3),
s AS (SELECT *, sum(m) OVER (PARTITION BY feature, bin) AS bm, sum(m) OVER (PARTITION BY feature, k) AS sm FROM m), h AS (SELECT feature, sum(-sm * ln(sm)) AS h FROM (SELECT DISTINCT feature, k, sum(m) OVER (PARTITION BY feature, k) AS sm FROM m) GROUP BY 1)
SELECT s.feature, round(sum(CASE WHEN m > 0 THEN m * ln(m / (bm * sm)) ELSE 0 END) / any_value(h.h), 8) AS ratio, max(n) AS support FROM s JOIN h ON s.feature = h.feature GROUP BY 1"""
)
def q_info_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.information_ratio(panels.lineitem_daily(spark, sf_dir), NAMES, panels.prob_pairs(spark, sf_dir))
    return out.select("feature", F.round("ratio", 8).alias("ratio"), "support")


@query(
    f"""WITH {_LONG}, e AS (SELECT feature, x, unnest(range(3)) AS k, unnest(p) AS w FROM l), s AS (SELECT feature, k, sum(w) AS w, sum(w * x) / sum(w) AS mean FROM e GROUP BY 1, 2),
t AS (SELECT feature, avg(x) AS centre, var_pop(x) AS variance, count(*) AS n FROM l GROUP BY 1)
SELECT feature, round(sum(w * (mean - centre) ** 2) / max(n) / max(variance), 8) AS eta2 FROM s JOIN t USING (feature) GROUP BY 1"""
)
def q_eta_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.eta_squared(panels.lineitem_daily(spark, sf_dir), NAMES, panels.prob_pairs(spark, sf_dir))
    return out.select("feature", F.round("eta2", 8).alias("eta2"))


_GRID = "g AS (SELECT k::BIGINT AS k, d::BIGINT AS d FROM range(2, 6) a(k), range(1, 13) b(d))"
_GAUSSIAN = "k - 1 + k * (k - 1) + k * d + k * d * (d + 1) // 2"


def _grid(spark: SparkSession) -> DataFrame:
    return spark.range(2, 6).withColumnRenamed("id", "k").crossJoin(F.broadcast(spark.range(1, 13).withColumnRenamed("id", "d")))


@query(f"WITH {_GRID} SELECT 'gaussian' AS family, k, d, ({_GAUSSIAN})::BIGINT AS parameters FROM g UNION ALL SELECT 'gmm', k, d, (k - 1 + k * (k - 1) + k + k * 2 * d + k * 2 * d * (d + 1) // 2)::BIGINT FROM g")
def q_param_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("k"), F.col("d")
    one = _grid(spark).select(F.lit("gaussian").alias("family"), "k", "d", C.gaussian_parameters(k, d).alias("parameters"))
    return one.union(_grid(spark).select(F.lit("gmm"), "k", "d", C.mixture_parameters(k, d, F.lit(2))))


@query(f"WITH {_GRID}, l AS (SELECT *, {_GAUSSIAN} AS m, -1000.0 - 10 * k + d AS ll FROM g) SELECT k, d, round(2 * m - 2 * ll, 6) AS aic, round(m * ln(2500) - 2 * ll, 6) AS bic FROM l")
def q_aic_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("k"), F.col("d")
    grid = _grid(spark).withColumn("m", C.gaussian_parameters(k, d)).withColumn("ll", -1000.0 - 10 * k + d)
    ll, m = F.col("ll").cast("double"), F.col("m")
    return grid.select("k", "d", F.round(C.aic(ll, m), 6).alias("aic"), F.round(C.bic(ll, m, F.lit(2500)), 6).alias("bic"))


@query(
    f"{with_panels(ORDERS_DAILY)}, z AS ({' UNION ALL '.join(f'SELECT count({c}) / count(*)::DOUBLE AS coverage, var_pop({c}) AS variance FROM orders_daily' for c in [*panels.PRIORITIES, 'total', 'n_orders'])}) "
    "SELECT CASE WHEN count(*) FILTER (WHERE coverage >= 0.9 AND variance > 1e-12) >= 3 THEN 'enough' ELSE 'too_few' END AS gate FROM z"
)
def q_minimum_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panels.orders_daily(spark, sf_dir)
    stats = quality.feature_quality(panel, [c for c in panel.columns if c != "ts"]).filter("eligible")
    return stats.agg(F.when(F.count("*") >= quality.MIN_FEATURES, "enough").otherwise("too_few").alias("gate"))
