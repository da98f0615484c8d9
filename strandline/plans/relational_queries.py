"""Queries of the relational and scalar operators inside the dataflows, each by itself."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import audit, clustering, correlation, selection
from ..sources import panels
from .catalogue import query
from .oracle_panels import EVENTS_HOURLY, FOLD_STATS, LINEITEM_DAILY, ORDERS_DAILY, PROB_PAIRS

_SETS = f"{FOLD_STATS}, kept AS (SELECT DISTINCT feature_name, fold_id FROM fold_stats WHERE representative), dropped AS (SELECT DISTINCT feature_name, fold_id FROM fold_stats WHERE eligible AND NOT representative)"


def _flags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    stats = panels.fold_stats(spark, sf_dir)
    key = ["feature_name", "fold_id"]
    return stats, stats.filter("representative").select(*key), stats.filter("eligible AND NOT representative").select(*key)


@query(f"WITH {_SETS} SELECT fold_id, feature_name, pca_credit FROM fold_stats s WHERE EXISTS (SELECT 1 FROM kept k WHERE k.fold_id = s.fold_id AND k.feature_name = s.feature_name)")
def q_retained_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, kept, _ = _flags(spark, sf_dir)
    return stats.join(kept, ["fold_id", "feature_name"], "left_semi").select("fold_id", "feature_name", "pca_credit")


@query(f"WITH {_SETS} SELECT fold_id, feature_name FROM fold_stats s WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.fold_id = s.fold_id AND k.feature_name = s.feature_name)")
def q_unselected_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, kept, _ = _flags(spark, sf_dir)
    return stats.join(kept, ["fold_id", "feature_name"], "left_anti").select("fold_id", "feature_name")


@query(f"WITH {_SETS} SELECT *, 'kept' AS part FROM kept UNION ALL SELECT *, 'dropped' FROM dropped")
def q_evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, kept, dropped = _flags(spark, sf_dir)
    return kept.withColumn("part", F.lit("kept")).unionByName(dropped.withColumn("part", F.lit("dropped")))


@query(f"WITH {_SETS} (SELECT feature_name, fold_id, 'left' AS side FROM (SELECT feature_name, fold_id FROM fold_stats EXCEPT ALL SELECT * FROM kept)) UNION ALL SELECT *, 'right' FROM (SELECT * FROM kept EXCEPT ALL SELECT feature_name, fold_id FROM fold_stats)")
def q_cover_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, kept, _ = _flags(spark, sf_dir)
    return audit.uncovered(stats.select("feature_name", "fold_id"), kept)


@query(f"WITH {ORDERS_DAILY}, {LINEITEM_DAILY} SELECT ts FROM orders_daily INTERSECT SELECT ts FROM lineitem_daily")
def q_shared_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.orders_daily(spark, sf_dir).select("ts").intersect(panels.lineitem_daily(spark, sf_dir).select("ts"))


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v, substr(md5(o_orderkey::VARCHAR), 1, 1) AS d FROM orders), e AS (SELECT k, v FROM o WHERE d <> '0'),
f AS (SELECT k, CASE WHEN d = '2' THEN v + 1 ELSE v END AS v FROM o WHERE d <> '1' UNION ALL SELECT k, v FROM o WHERE d = '3'),
a AS (SELECT k, count(*) AS n, max(v) AS v FROM e GROUP BY 1), b AS (SELECT k, count(*) AS n, max(v) AS v FROM f GROUP BY 1),
j AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'unexpected' WHEN a.n > 1 OR b.n > 1 THEN 'repeated' WHEN NOT abs(a.v - b.v) <= 1e-10 THEN 'differs' END AS problem FROM a FULL JOIN b ON a.k = b.k)
SELECT * FROM j WHERE problem IS NOT NULL"""
)
def q_result_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit over all orders; the first digit of a key's hash says which of them are unexpected, missing, different or repeated."""
    orders = panels.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    orders = orders.withColumn("d", F.substring(F.md5(F.col("k").cast("string").cast("binary")), 1, 1))
    found = orders.filter("d <> '1'").withColumn("v", F.when(F.col("d") == "2", F.col("v") + 1).otherwise(F.col("v")))
    found = found.unionByName(orders.filter("d = '3'"))
    return audit.compare(orders.filter("d <> '0'"), found, ["k"], "v")


@query(
    f"""WITH {PROB_PAIRS} SELECT ts, (list_position(p, list_max(p)) - 1)::BIGINT AS dominant, abs(list_sum(p) - 1) <= 1e-10 AS normalised, round(p[3], 9) AS p0, round(p[1], 9) AS p1, round(p[2], 9) AS p2 FROM prob_pairs"""
)
def q_state_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, moved = F.col("p"), C.permuted(F.col("p"), [2, 0, 1])
    rows = panels.prob_pairs(spark, sf_dir)
    return rows.select("ts", C.dominant(p).cast("long").alias("dominant"), C.normalised(p).alias("normalised"), *[F.round(moved[k], 9).alias(f"p{k}") for k in range(3)])


NU, MIX = 6.0, (0.35, 0.65)
_CENTRE, _SCALE = [3.8e4, 25.0], [[4.0e7, 900.0], [900.0, 9.0]]


def _form(shift: float) -> tuple[str, float]:
    (a, b), (_, d) = _SCALE
    det = a * d - b * b
    x, y = f"(price - {_CENTRE[0] + shift})", f"(quantity - {_CENTRE[1]})"
    return f"(({d} * {x} * {x} - 2 * {b} * {x} * {y} + {a} * {y} * {y}) / {det!r})", math.log(det)


def _normal(shift: float) -> str:
    q, logdet = _form(shift)
    return f"(-0.5 * ({q} + {2 * math.log(2 * math.pi) + logdet!r}))"


_Q, _LOGDET = _form(0.0)
_T = f"{math.lgamma((NU + 2) / 2) - math.lgamma(NU / 2) - 0.5 * (2 * math.log(NU * math.pi) + _LOGDET)!r} - {(NU + 2) / 2} * ln(1 + {_Q} / {NU})"
_LSE = f"ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) + greatest(a, b)"


@query(
    f"WITH {LINEITEM_DAILY}, m AS (SELECT ts, {_T} AS t, {math.log(MIX[0])!r} + {_normal(-500.0)} AS a, {math.log(MIX[1])!r} + {_normal(500.0)} AS b FROM lineitem_daily WHERE price IS NOT NULL AND quantity IS NOT NULL) "
    f"SELECT ts, round(t, 7) AS student_t, round({_LSE}, 7) AS mixture FROM m"
)
def q_log_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = [F.col("price"), F.col("quantity")]
    parts = [F.lit(math.log(w)) + C.gaussian_log_density(x, [_CENTRE[0] + s, _CENTRE[1]], _SCALE) for w, s in zip(MIX, (-500.0, 500.0), strict=True)]
    rows = panels.lineitem_daily(spark, sf_dir).na.drop("any", subset=["price", "quantity"])
    return rows.select("ts", F.round(C.student_t_log_density(x, _CENTRE, _SCALE, NU), 7).alias("student_t"), F.round(C.log_sum_exp(parts), 7).alias("mixture"))


@query(f"WITH {EVENTS_HOURLY} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS step_us FROM events_hourly")
def q_utc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = panels.events_hourly(spark, sf_dir).select("ts")
    step = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(W.orderBy("ts"))
    return hours.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), step.alias("step_us"))


@query(f"WITH {ORDERS_DAILY}, {LINEITEM_DAILY} SELECT o.ts, round(o.total, 2) AS total, round(l.price, 6) AS price FROM orders_daily o LEFT JOIN lineitem_daily l ON o.ts = l.ts WHERE o.n_orders >= 8")
def q_panel_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = panels.orders_daily(spark, sf_dir), panels.lineitem_daily(spark, sf_dir)
    return orders.filter("n_orders >= 8").join(lines, "ts", "left").select("ts", F.round("total", 2).alias("total"), F.round("price", 6).alias("price"))


@query(
    f"""WITH {FOLD_STATS}, r AS (SELECT *, row_number() OVER (PARTITION BY feature_name ORDER BY fold_id DESC) AS rn FROM fold_stats WHERE eligible)
SELECT feature_name, fold_id, rn::BIGINT AS age FROM r WHERE rn <= 3"""
)
def q_recent_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible = panels.fold_stats(spark, sf_dir).filter("eligible")
    rn = F.row_number().over(W.partitionBy("feature_name").orderBy(F.desc("fold_id"))).cast("long")
    return eligible.select("feature_name", "fold_id", rn.alias("age")).filter("age <= 3")


@query()
def q_feature_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    names = list(panels.EVENTS)
    distance = np.zeros((len(names), len(names)))
    for r in correlation.spearman_distance(panels.events_hourly(spark, sf_dir), {"events": names}).collect():
        i, j = names.index(r["left"]), names.index(r["right"])
        distance[i, j] = distance[j, i] = r["distance"]
    found = clustering.best_cut(distance)
    return spark.createDataFrame([(n, found.labels[k], k in found.medoids) for k, n in enumerate(names)], "feature string, cluster long, medoid boolean")


@query(f"WITH {FOLD_STATS} SELECT feature_name AS candidate, count(*) AS planned, count(*) FILTER (WHERE eligible) AS valid_n, count(*) FILTER (WHERE eligible) / count(*)::DOUBLE >= 0.8 AND count(*) FILTER (WHERE eligible) >= 3 AS production FROM fold_stats GROUP BY 1")
def q_production_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = panels.fold_stats(spark, sf_dir).select(F.col("feature_name").alias("candidate"), "eligible", F.lit(1.0).alias("one"))
    return selection.fold_aggregation(stats, "one", valid="eligible").select("candidate", "planned", "valid_n", "production")
