"""Queries over panels: reading, quality, calendar, roles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import calendar, quality, roles
from ..sources import features, panels
from .catalogue import query
from .oracle_panels import EVENTS_HOURLY, LINEITEM_DAILY, ORDERS_DAILY, with_panels

PRIORITIES = list(panels.PRIORITIES)
START, END = dt.date(1996, 1, 1), dt.date(1998, 12, 31)
_BETWEEN = f"ts BETWEEN DATE '{START}' AND DATE '{END}'"
_COMPLETE = " AND ".join(f"{p} IS NOT NULL" for p in PRIORITIES)


@query(f"{with_panels(ORDERS_DAILY)} SELECT ts, {', '.join(PRIORITIES)} FROM orders_daily WHERE {_BETWEEN}")
def q_panel_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = features.PanelSource(panels.orders_daily(spark, sf_dir))
    return source.read(features.Request(tuple(PRIORITIES), START, END))


@query("SELECT * FROM (VALUES " + ", ".join(f"({k + 1}::BIGINT, '{n}', 'double')" for k, n in enumerate([*PRIORITIES, "total", "n_orders"])) + ") t(ordinal, name, type)")
def q_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.catalog(panels.orders_daily(spark, sf_dir))


@query(f"{with_panels(ORDERS_DAILY)} SELECT ts, {', '.join(PRIORITIES)} FROM orders_daily WHERE {_COMPLETE}")
def q_complete_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = features.PanelSource(panels.orders_daily(spark, sf_dir))
    return source.read(features.Request(tuple(PRIORITIES), mode=features.RESOLVED_MODEL))


@query(f"{with_panels(ORDERS_DAILY)} SELECT count(*) AS total, count(*) FILTER (WHERE {_COMPLETE}) AS retained, count(*) FILTER (WHERE NOT ({_COMPLETE})) AS skipped FROM orders_daily")
def q_skipped_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.PanelSource(panels.orders_daily(spark, sf_dir)).skipped(features.Request(tuple(PRIORITIES)))


@query("SELECT (count(*) - count(DISTINCT ts))::BIGINT AS violations FROM events")
def q_monotonic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.violations(panels.table(spark, sf_dir, "events").select("ts"))


def _quality_sql(panel: str, names: list[str]) -> str:
    parts = [
        f"SELECT '{panel}' AS panel, '{n}' AS feature, count({n}) AS finite_count, count({n}) / count(*)::DOUBLE AS coverage, var_pop({n}) AS variance FROM {panel}" for n in names
    ]
    return " UNION ALL ".join(parts)


_QUALITY = ", ".join(
    [
        ORDERS_DAILY,
        EVENTS_HOURLY,
        "s AS (" + _quality_sql("orders_daily", [*PRIORITIES, "total", "n_orders"]) + " UNION ALL " + _quality_sql("events_hourly", list(panels.EVENTS)) + ")",
        "r AS (SELECT *, CASE WHEN coverage < 0.90 THEN 'coverage_below_minimum' WHEN variance IS NULL OR variance <= 1e-12 THEN 'variance_below_or_equal_minimum' END AS reason FROM s)",
    ]
)


@query(f"WITH {_QUALITY} SELECT panel, feature, finite_count, round(coverage, 9) AS coverage, round(sqrt(variance), 6) AS deviation, reason IS NULL AS eligible, reason FROM r")
def q_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(name: str, panel: DataFrame) -> DataFrame:
        return quality.feature_quality(panel, [c for c in panel.columns if c != "ts"]).withColumn("panel", F.lit(name))

    both = one("orders_daily", panels.orders_daily(spark, sf_dir)).unionByName(one("events_hourly", panels.events_hourly(spark, sf_dir)))
    return both.select("panel", "feature", "finite_count", F.round("coverage", 9).alias("coverage"), F.round(F.sqrt("variance"), 6).alias("deviation"), "eligible", "reason")


PROFILE = roles.RoleProfile(core=("economy", "small"), families=("brand", "brand_ring", "brand_bolt"))
_NAMES = """names AS (SELECT DISTINCT lower(p_type) AS name FROM part UNION
  SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN 'brand_ring_' WHEN p_size % 3 = 1 THEN 'brand_' ELSE 'brand_bolt_mean_' END || p_size::VARCHAR FROM part)"""
_ROLES = f"""WITH {_NAMES}, f AS (SELECT name, CASE WHEN starts_with(name, 'brand_bolt_') THEN 'brand_bolt' WHEN starts_with(name, 'brand_ring_') THEN 'brand_ring'
  WHEN starts_with(name, 'brand_') THEN 'brand' END AS fam FROM names),
r AS (SELECT name, fam, CASE WHEN name IN ('economy', 'small') THEN 'core' WHEN regexp_matches(name, '^family_pc_[a-z0-9_]+_[1-8]$') OR regexp_matches(name, '^pca_pc_[0-9]{{3}}$') THEN 'generated'
  WHEN fam IS NOT NULL AND regexp_matches(name, '^[a-z0-9_]+_[0-9]+$') THEN 'transformation' END AS role FROM f)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = panels.table(spark, sf_dir, "part")
    kind = F.col("p_size") % 3
    made = F.concat(F.when(kind == 0, "brand_ring_").when(kind == 1, "brand_").otherwise("brand_bolt_mean_"), F.col("p_size").cast("string"))
    return part.select(F.lower("p_type").alias("name")).union(part.select(made)).distinct()


@query(f"{_ROLES} SELECT name, role, CASE WHEN role = 'transformation' THEN fam END AS family FROM r")
def q_role_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.classify(_names(spark, sf_dir), PROFILE)


@query(
    f"""{_ROLES}, t AS (SELECT name, fam AS family, regexp_extract(name, '_([0-9]+)$', 1)::BIGINT AS "window", substr(regexp_replace(name, '_[0-9]+$', ''), length(fam) + 2) AS part FROM r WHERE role = 'transformation'),
u AS (SELECT *, CASE WHEN part <> '' THEN part ELSE family END AS transformation FROM t)
SELECT sha256(family || '|' || transformation || '|' || "window"::VARCHAR || '|' || name) AS feature_identity, name, family, transformation, "window" FROM u"""
)
def q_feature_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.provenance(_names(spark, sf_dir), PROFILE)


@query(f"{_ROLES} SELECT c.name FROM (VALUES ('economy'), ('small'), ('absent')) c(name) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.name = c.name AND r.role = 'core')")
def q_missing_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = roles.RoleProfile((*PROFILE.core, "absent"), PROFILE.families)
    return roles.missing_core(roles.classify(_names(spark, sf_dir), profile), profile)


@query(f"{_ROLES} SELECT 'hmm_input' AS stage, name, role FROM r WHERE role IS NOT NULL AND role NOT IN ('core', 'generated')")
def q_stage_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = roles.classify(_names(spark, sf_dir), PROFILE).filter("role IS NOT NULL").select(F.lit("hmm_input").alias("stage"), "name", "role")
    allowed = spark.createDataFrame([("hmm_input", roles.CORE), ("hmm_input", roles.GENERATED)], "stage string, role string")
    return roles.breaches(known, allowed).select("stage", "name", "role")


@query("SELECT strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin', '%Y-%m') AS local_month, count(*) AS n FROM events GROUP BY 1")
def q_month_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = panels.table(spark, sf_dir, "events")
    return events.groupBy(F.date_format(C.local_month(F.col("ts")), "yyyy-MM").alias("local_month")).agg(F.count("*").alias("n"))


_FOLDS = f"""{ORDERS_DAILY}, months AS (SELECT date_trunc('month', ts)::DATE AS month, min(ts) AS first, max(ts) AS last, count(*) AS n FROM orders_daily GROUP BY 1),
steps AS (SELECT *, sum(n) OVER o AS train_n, min(first) OVER o AS train_first, max(last) OVER () AS source_end, lead(month) OVER m AS test_month, lead(first) OVER m AS test_first, lead(last) OVER m AS test_last,
  lead(n) OVER m AS test_n FROM months WINDOW o AS (ORDER BY month ROWS UNBOUNDED PRECEDING), m AS (ORDER BY month)),
folds AS (SELECT 'fold_' || lpad((row_number() OVER (ORDER BY month) - 1)::VARCHAR, 3, '0') AS fold_id, strftime(month, '%Y-%m') AS train_month, strftime(test_month, '%Y-%m') AS test_month,
  train_first, last AS train_cutoff, test_first, test_last, train_n::BIGINT AS train_n, test_n::BIGINT AS test_n
  FROM steps WHERE test_month = month + INTERVAL 1 MONTH AND train_n >= 1260 AND source_end >= last_day(test_month))"""


@query(f"WITH {_FOLDS} SELECT * FROM folds")
def q_calendar_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.plan_folds(panels.orders_daily(spark, sf_dir).select("ts"))


@query(
    f"""WITH {_FOLDS} SELECT fold_id, count(*) FILTER (WHERE ts <= train_cutoff) AS train_n, count(*) FILTER (WHERE ts >= f.test_first) AS test_n
FROM orders_daily JOIN folds f ON ts BETWEEN f.train_first AND f.test_last GROUP BY 1"""
)
def q_fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panels.orders_daily(spark, sf_dir).select("ts")
    return calendar.fold_counts(panel, calendar.plan_folds(panel))


SCALED = ["price", "discount", "quantity"]
LINE_FOLDS = _FOLDS.replace(ORDERS_DAILY, LINEITEM_DAILY).replace("orders_daily", "lineitem_daily")


@query(
    f"WITH {LINE_FOLDS}, x AS (SELECT fold_id, {', '.join(SCALED)} FROM lineitem_daily JOIN folds ON ts BETWEEN train_first AND train_cutoff), s AS ("
    + " UNION ALL ".join(f"SELECT fold_id, '{c}' AS feature, count({c}) AS n, avg({c}) AS mean, var_pop({c}) AS variance FROM x GROUP BY 1" for c in SCALED)
    + ") SELECT fold_id, feature, n, round(mean, 6) AS mean, round(variance, 4) AS variance, round(CASE WHEN variance > 0 THEN sqrt(variance) ELSE 1.0 END, 6) AS scale FROM s"
)
def q_train_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panels.lineitem_daily(spark, sf_dir)
    rows = calendar.fold_rows(panel, calendar.plan_folds(panel.select("ts"))).filter("part = 'train'")
    stats = quality.train_scaler(rows.select("fold_id", *SCALED), SCALED)
    return stats.select("fold_id", "feature", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("scale", 6).alias("scale"))


@query(
    f"{with_panels(LINEITEM_DAILY)} SELECT ts, "
    + ", ".join(f"round((price - avg(price) OVER ()) / sqrt(var_pop(price) OVER ()), 7) AS price".replace("price", c) for c in SCALED)
    + f" FROM lineitem_daily WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SCALED)}"
)
def q_scaled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = quality.scaled(panels.lineitem_daily(spark, sf_dir).select("ts", *SCALED), SCALED)
    return z.select("ts", *[F.round(c, 7).alias(c) for c in SCALED])


@query(
    f"""{with_panels(ORDERS_DAILY)}, d AS (SELECT date_diff('day', max(ts), DATE '2001-08-20')::DOUBLE AS days FROM orders_daily)
SELECT days, CASE WHEN days > 35 THEN 'failed' WHEN days > 7 THEN 'degraded' ELSE 'fresh' END AS data_state, CASE WHEN days > 14 THEN 'failed' WHEN days > 4 THEN 'degraded' ELSE 'fresh' END AS loader_state FROM d"""
)
def q_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = C.FRESHNESS
    days = panels.orders_daily(spark, sf_dir).agg(C.elapsed_days(F.max("ts"), F.lit(dt.date(2001, 8, 20))).alias("days"))
    d = F.col("days")
    return days.select("days", C.freshness(d, limits["data_warn"], limits["data_fail"]).alias("data_state"), C.freshness(d, limits["loader_warn"], limits["loader_fail"]).alias("loader_state"))


@query("SELECT f || '_k' || k::VARCHAR AS candidate_id, f AS family, k::BIGINT AS k, (CASE WHEN f = 'gmm' THEN 2 ELSE 1 END)::BIGINT AS mixtures FROM (VALUES ('gaussian'), ('gmm'), ('student_t')) a(f), range(2, 6) b(k)")
def q_candidate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.selection import candidate_grid

    return candidate_grid(spark)


_PACKAGES = "packages AS (SELECT strftime(o_orderdate, '%Y-%m') AS available_for_test_month, count(*) AS orders FROM orders GROUP BY 1)"


@query(f"WITH {_PACKAGES} SELECT * FROM packages WHERE available_for_test_month <= '1998-05' ORDER BY available_for_test_month DESC LIMIT 1")
def q_package_for_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = panels.table(spark, sf_dir, "orders")
    packages = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("available_for_test_month")).agg(F.count("*").alias("orders"))
    return calendar.package_for_month(packages, "1998-05")


@query(
    f"""{with_panels(ORDERS_DAILY)} SELECT 'orders' AS source_dataset, 'build-1' AS source_build_id, count(*) AS row_count, min(ts) AS min_timestamp, max(ts) AS max_timestamp,
  sha256((SELECT string_agg(sha256(ts::VARCHAR || '|' || round(total * 100)::BIGINT::VARCHAR || '|' || n_orders::BIGINT::VARCHAR), '' ORDER BY ts) FROM orders_daily)) AS content FROM orders_daily"""
)
def q_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineage row; its own hash is of the rows' binary values, so a hash over their text, which SQL has too, stands beside the bounds."""
    panel = panels.orders_daily(spark, sf_dir)
    row = features.lineage(panel, "orders", "build-1").select("source_dataset", "source_build_id", "row_count", "min_timestamp", "max_timestamp")
    text = F.concat_ws("|", F.col("ts").cast("string"), F.round(F.col("total") * 100).cast("long").cast("string"), F.col("n_orders").cast("long").cast("string"))
    each = panel.select("ts", F.sha2(text.cast("binary"), 256).alias("h"))
    days = each.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "h"))), lambda r: r["h"]), "").alias("all"))  # a row per day
    return row.crossJoin(F.broadcast(days.select(F.sha2(F.col("all").cast("binary"), 256).alias("content"))))


@query(
    f"""{with_panels(EVENTS_HOURLY)}, m AS (SELECT date_trunc('month', ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin')::DATE AS month, count(*) AS n FROM events_hourly GROUP BY 1)
SELECT month, n, (SELECT max((ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin')::DATE) FROM events_hourly) >= last_day(month) AS closed FROM m"""
)
def q_closed_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.causal import closed_months

    return closed_months(panels.events_hourly(spark, sf_dir))
