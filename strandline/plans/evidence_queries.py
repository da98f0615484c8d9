"""Queries of scores, ranking, evidence tables and lifecycle, over evidence derived from the orders table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evidence, selection
from ..sources import panels
from .catalogue import query
from .oracle_panels import FOLD_STATS

#: A row per candidate (market segment of the customer) and fold (month), with parts derived from the month's cents.
_CENTS = """cents AS (SELECT c_mktsegment AS candidate, strftime(o_orderdate, '%Y-%m') AS fold_id, round(sum(o_totalprice) * 100)::BIGINT AS c
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
_EVIDENCE = f"""{_CENTS}, ev AS (SELECT candidate, fold_id, c % 13 <> 0 AS valid, (c % 997)::DOUBLE / 997 AS target, (c % 499)::DOUBLE / 998 AS baseline, (c % 101)::DOUBLE / 101 AS calibration,
  (c % 103)::DOUBLE / 103 AS stability, (c % 107)::DOUBLE / 107 AS support FROM cents)"""
_SCORES = f"""{_EVIDENCE}, s AS (SELECT candidate, count(*) AS planned, count(*) FILTER (WHERE valid) AS valid_n, avg(0.5 + 0.5 * tanh(target - baseline)) FILTER (WHERE valid) AS forecast,
  min(0.5 + 0.5 * tanh(target - baseline)) FILTER (WHERE valid) AS worst, avg(calibration) FILTER (WHERE valid) AS calibration, avg(stability) FILTER (WHERE valid) AS stability,
  avg(support) FILTER (WHERE valid) AS support, arg_max(valid, fold_id) AS latest_valid FROM ev GROUP BY 1),
r AS (SELECT *, valid_n / planned::DOUBLE AS rate, array_to_string(list_filter([CASE WHEN valid_n = 0 THEN 'no_valid_fold' END, CASE WHEN valid_n / planned::DOUBLE < 0.8 THEN 'valid_rate' END,
  CASE WHEN valid_n < 3 THEN 'too_few_valid_folds' END, CASE WHEN NOT latest_valid THEN 'latest_fold_invalid' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s),
b AS (SELECT *, 0.5 * rate + 0.25 * worst + 0.25 * support AS robustness FROM r),
scores AS (SELECT *, reasons = '' AS eligible, CASE WHEN reasons = '' THEN 0.5 * forecast + 0.2 * calibration + 0.2 * stability + 0.1 * robustness END AS total FROM b)"""


def _cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = panels.table(spark, sf_dir, "orders"), panels.table(spark, sf_dir, "customer")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey)
    month = F.date_format("o_orderdate", "yyyy-MM")
    return rows.groupBy(F.col("c_mktsegment").alias("candidate"), month.alias("fold_id")).agg(F.round(F.sum("o_totalprice") * 100).cast("long").alias("c"))


def fold_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda m, d=None: (F.col("c") % m).cast("double") / (d or m)
    return _cents(spark, sf_dir).select(
        "candidate", "fold_id", (F.col("c") % 13 != 0).alias("valid"), part(997).alias("target"), part(499, 998).alias("baseline"),
        part(101).alias("calibration"), part(103).alias("stability"), part(107).alias("support"),
    )


_PARTS = ["rate", "forecast", "calibration", "stability", "robustness", "worst", "total"]


@query(f"WITH {_SCORES} SELECT candidate, planned, valid_n, " + ", ".join(f"round({c}, 8) AS {c}" for c in _PARTS) + ", eligible, reasons FROM scores")
def q_subset_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = selection.subset_scores(fold_evidence(spark, sf_dir))
    return s.select("candidate", "planned", "valid_n", *[F.round(c, 8).alias(c) for c in _PARTS], "eligible", "reasons")


@query(
    f"WITH {_SCORES} SELECT row_number() OVER (ORDER BY round(total, 8) DESC, round(forecast, 8) DESC, round(worst, 8) DESC, round(calibration, 8) DESC, round(stability, 8) DESC, round(robustness, 8) DESC, candidate) AS rank, "
    "candidate, round(total, 8) AS total FROM scores WHERE eligible"
)
def q_rank_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.rank_subsets(q_subset_score(spark, sf_dir))


@query(
    f"""WITH {_EVIDENCE}, a AS (SELECT candidate, count(*) AS planned, count(*) FILTER (WHERE valid) AS valid_n, avg(target) FILTER (WHERE valid) AS mean, min(target) FILTER (WHERE valid) AS worst FROM ev GROUP BY 1)
SELECT candidate, planned, valid_n, round(mean, 8) AS mean, round(worst, 8) AS worst, round(valid_n / planned::DOUBLE, 8) AS rate, valid_n >= 3 AND valid_n / planned::DOUBLE >= 0.8 AS production FROM a"""
)
def q_fold_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.fold_aggregation(fold_evidence(spark, sf_dir), "target")
    return out.select("candidate", "planned", "valid_n", *[F.round(c, 8).alias(c) for c in ("mean", "worst", "rate")], "production")


@query(f"WITH {_CENTS}, st AS (SELECT candidate, fold_id, (c % 50)::DOUBLE AS ll, (c % 1009)::BIGINT AS seed FROM cents) SELECT fold_id, min(seed) AS seed FROM st s WHERE ll >= (SELECT max(ll) FROM st t WHERE t.fold_id = s.fold_id) - 5 GROUP BY 1")
def q_anchored_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    starts = _cents(spark, sf_dir).select("fold_id", (c % 50).cast("double").alias("ll"), (c % 1009).alias("seed"))
    return selection.anchored_winner(starts, "ll", "seed", 5.0, ("fold_id",)).select("fold_id", "seed")


#: Candidates of the anchored ranking: months, by coarse metrics, so that ties within the tolerance occur.
_METRICS = [("m1", 2.0), ("m2", 1.0), ("m3", 3.0)]


def _anchored_sql() -> str:
    """Subgroups by recursion: the best of what a group has left, and all within tolerance of it, leave together."""
    steps = ["g0 AS (SELECT fold_id AS candidate, ''::VARCHAR AS path, (sum(c) % 7)::DOUBLE AS m1, (sum(c) % 5)::DOUBLE AS m2, (sum(c) % 11)::DOUBLE AS m3 FROM cents GROUP BY 1)"]
    for k, (m, t) in enumerate(_METRICS):
        steps.append(
            f"a{k}(path, anchor, n) AS (SELECT path, max({m}), 1 FROM g{k} GROUP BY 1 UNION ALL SELECT * FROM (SELECT a{k}.path, (SELECT max(g.{m}) FROM g{k} g WHERE g.path = a{k}.path AND g.{m} < a{k}.anchor - {t}) AS anchor, n + 1 FROM a{k}) WHERE anchor IS NOT NULL)"
        )
        steps.append(f"g{k + 1} AS (SELECT g.candidate, g.path || lpad(min(a.n)::VARCHAR, 4, '0') AS path, m1, m2, m3 FROM g{k} g JOIN a{k} a ON a.path = g.path AND g.{m} >= a.anchor - {t} GROUP BY g.candidate, g.path, m1, m2, m3)")
    return "WITH RECURSIVE " + ", ".join([_CENTS, *steps]) + f" SELECT row_number() OVER (ORDER BY path, candidate) AS rank, candidate FROM g{len(_METRICS)}"


@query(_anchored_sql())
def q_anchored_family_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = _cents(spark, sf_dir).groupBy(F.col("fold_id").alias("candidate")).agg(F.sum("c").alias("c"))
    rows = months.select("candidate", *[(F.col("c") % m).cast("double").alias(n) for n, m in (("m1", 7), ("m2", 5), ("m3", 11))])
    return selection.anchored_ranking(rows, _METRICS)


_PREFIX = f"{_CENTS}, px AS (SELECT (c % 4 + 2)::BIGINT AS k, (c % 30)::DOUBLE / 30 AS nmi, (c % 7)::DOUBLE / 7 AS support, (c % 9 + 1)::BIGINT AS length FROM cents)"


@query(
    f"""WITH {_PREFIX}, a AS (SELECT * FROM px p WHERE nmi >= (SELECT max(nmi) FROM px x WHERE x.k = p.k) - 1e-12), b AS (SELECT * FROM a p WHERE support >= (SELECT max(support) FROM a x WHERE x.k = p.k) - 1e-12)
SELECT k, min(length) AS length FROM b GROUP BY 1"""
)
def q_prefix_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    rows = _cents(spark, sf_dir).select((c % 4 + 2).alias("k"), ((c % 30).cast("double") / 30).alias("nmi"), ((c % 7).cast("double") / 7).alias("support"), (c % 9 + 1).alias("length"))
    return selection.prefix_selection(rows)


_GLOBAL = ["selection_rate", "mean_loss", "median_loss", "total_credit"]


@query(
    f"""WITH {FOLD_STATS}, a AS (SELECT *, row_number() OVER (PARTITION BY feature_name ORDER BY fold_id DESC) - 1 AS age FROM fold_stats),
g AS (SELECT feature_name, count(*) AS folds, count(*) FILTER (WHERE eligible) AS eligible_folds, count(*) FILTER (WHERE representative) AS representative_folds, count(*) FILTER (WHERE sffs_participation) AS sffs_folds,
  count(*) FILTER (WHERE final_selection) AS selected_folds, avg(ablation_loss) FILTER (WHERE final_selection) AS mean_loss, median(ablation_loss) FILTER (WHERE final_selection) AS median_loss,
  sum(pca_credit) FILTER (WHERE pc_participation) AS total_credit, max(fold_id) FILTER (WHERE final_selection) AS last_selected, coalesce(min(age) FILTER (WHERE final_selection), count(*))::BIGINT AS folds_since_selection FROM a GROUP BY 1),
h AS (SELECT *, selected_folds / nullif(eligible_folds, 0)::DOUBLE AS selection_rate FROM g)
SELECT feature_name, folds, eligible_folds, representative_folds, sffs_folds, selected_folds, last_selected, folds_since_selection, {", ".join(f"round({c}, 8) AS {c}" for c in _GLOBAL)} FROM h"""
)
def q_global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = evidence.global_stats(panels.fold_stats(spark, sf_dir))
    return g.select(
        "feature_name", "folds", "eligible_folds", "representative_folds", "sffs_folds", "selected_folds", "last_selected", "folds_since_selection", *[F.round(c, 8).alias(c) for c in _GLOBAL]
    )


_KEY = ["fold_id", "feature_name"]
_STORED = "fold_id < '1999'"
_NEW = "fold_id >= '1998'"


@query(f"WITH {FOLD_STATS} SELECT fold_id, feature_name, eligible, CASE WHEN {_NEW} THEN round(ablation_loss + 1, 6) ELSE round(ablation_loss, 6) END AS ablation_loss FROM fold_stats")
def q_upsert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = panels.fold_stats(spark, sf_dir).select(*_KEY, "eligible", "ablation_loss")
    new = stats.filter(_NEW).withColumn("ablation_loss", F.col("ablation_loss") + 1)
    return evidence.upsert(stats.filter(_STORED), new, _KEY).select(*_KEY, "eligible", F.round("ablation_loss", 6).alias("ablation_loss"))


@query(
    f"""WITH {FOLD_STATS} SELECT count(*) FILTER (WHERE fold_id >= '1999') AS inserted, count(*) FILTER (WHERE fold_id >= '1998' AND fold_id < '1999' AND ablation_loss IS NOT NULL) AS conflicting FROM fold_stats"""
)
def q_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = panels.fold_stats(spark, sf_dir).select(*_KEY, "eligible", "ablation_loss")
    old, new = stats.filter(_STORED), stats.filter(_NEW).withColumn("ablation_loss", F.col("ablation_loss") + 1)
    inserted = evidence.absent(old, new, _KEY).agg(F.count("*").alias("inserted"))
    return inserted.crossJoin(evidence.conflicts(old, new, _KEY).agg(F.count("*").alias("conflicting")))  # one row each


@query(
    f"""WITH {FOLD_STATS}, l AS (SELECT feature_name, avg(ablation_loss) AS loss FROM fold_stats WHERE final_selection AND feature_name <> '5-LOW' GROUP BY 1), t AS (SELECT * FROM fold_stats WHERE fold_id = (SELECT max(fold_id) FROM fold_stats))
SELECT t.feature_name, t.final_selection OR l.loss IS NOT NULL AS final_selection, round(coalesce(l.loss, t.ablation_loss), 8) AS ablation_loss FROM t LEFT JOIN l ON t.feature_name = l.feature_name"""
)
def q_ablation_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = panels.fold_stats(spark, sf_dir)
    losses = stats.filter("final_selection AND feature_name <> '5-LOW'").groupBy("feature_name").agg(F.avg("ablation_loss").alias("loss"))
    last = stats.agg(F.max("fold_id").alias("last"))
    latest = stats.join(F.broadcast(last), F.col("fold_id") == F.col("last")).drop("last")
    return evidence.with_ablation(latest, losses).select("feature_name", "final_selection", F.round("ablation_loss", 8).alias("ablation_loss"))


_LOADINGS = """loadings AS (SELECT fold_id AS family, (c % 3 + 1)::INT AS pc_ordinal, candidate AS source_feature, ((c % 200) - 100)::DOUBLE / 100 AS loading FROM cents),
losses AS (SELECT fold_id AS family, k::INT AS pc_ordinal, ((sum(c) % 41) - 20)::DOUBLE / 20 AS loss FROM cents, range(1, 4) r(k) GROUP BY 1, 2)"""


@query(f"WITH {_CENTS}, {_LOADINGS} SELECT source_feature AS feature, round(sum(abs(loss) * loading * loading), 7) AS credit FROM loadings JOIN losses USING (family, pc_ordinal) GROUP BY 1")
def q_pca_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents, c = _cents(spark, sf_dir), F.col("c")
    loading = ((c % 200) - 100).cast("double") / 100
    loadings = cents.select(F.col("fold_id").alias("family"), (c % 3 + 1).cast("int").alias("pc_ordinal"), F.col("candidate").alias("source_feature"), (loading * loading).alias("squared_loading"))
    sums = cents.groupBy(F.col("fold_id").alias("family")).agg(F.sum("c").alias("c"))
    losses = sums.select("family", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("pc_ordinal"), (((c % 41) - 20).cast("double") / 20).alias("loss"))
    return evidence.pca_credit(loadings, losses).select("feature", F.round("credit", 7).alias("credit"))


_REGISTRY = [("1-URGENT", "transformation", "deprecated"), ("2-HIGH", "core", "active"), ("3-MEDIUM", "transformation", "active"), ("absent", "transformation", "active")]


@query(
    f"""WITH {FOLD_STATS}, reg(feature_name, role, lifecycle_status) AS (VALUES {", ".join(str(r) for r in _REGISTRY)}),
e AS (SELECT *, row_number() OVER (PARTITION BY feature_name ORDER BY fold_id DESC) AS age FROM fold_stats WHERE eligible),
s AS (SELECT feature_name, count(*) AS eligible_folds, sum(coalesce(pca_credit, 0)) AS total_credit, sum(CASE WHEN age <= 20 THEN coalesce(pca_credit, 0) ELSE 0 END) AS recent_credit,
  count(*) FILTER (WHERE age <= 20 AND final_selection) AS recent_selected, count(*) FILTER (WHERE age <= 20 AND representative) AS recent_representative FROM e GROUP BY 1),
j AS (SELECT reg.*, coalesce(eligible_folds, 0) AS eligible_folds, coalesce(total_credit, 0) AS total_credit, coalesce(recent_credit, 0) AS recent_credit, coalesce(recent_selected, 0) AS recent_selected,
  coalesce(recent_representative, 0) AS recent_representative FROM reg LEFT JOIN s USING (feature_name)),
k AS (SELECT *, recent_selected = 0 AND recent_representative = 0 AND recent_credit < 1e-12 AS idle FROM j),
m AS (SELECT *, CASE WHEN lifecycle_status = 'deprecated' AND NOT idle THEN 'reactivate' WHEN eligible_folds >= 20 AND idle AND role = 'transformation' THEN 'deprecate' WHEN eligible_folds >= 20 AND idle THEN 'review' ELSE 'keep' END AS recommended FROM k)
SELECT feature_name, role, eligible_folds, round(total_credit, 6)::DOUBLE AS total_credit, round(recent_credit, 6)::DOUBLE AS recent_credit, recent_selected, recent_representative, recommended,
  role = 'transformation' AND recommended IN ('deprecate', 'reactivate') AS automatic FROM m"""
)
def q_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame(_REGISTRY, "feature_name string, role string, lifecycle_status string")
    out = evidence.lifecycle(registry, panels.fold_stats(spark, sf_dir))
    return out.withColumn("total_credit", F.round("total_credit", 6)).withColumn("recent_credit", F.round("recent_credit", 6))


@query(f"WITH {_CENTS} SELECT candidate, sha256(candidate || '|' || count(*)::VARCHAR) AS tuple_hash, string_agg(fold_id, '|' ORDER BY fold_id) AS tuple_key FROM cents GROUP BY 1")
def q_tuple_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = _cents(spark, sf_dir).groupBy("candidate").agg(F.array_sort(F.collect_list("fold_id")).alias("folds"))
    text = F.concat_ws("|", "candidate", F.size("folds").cast("string"))
    return folds.select("candidate", F.sha2(text.cast("binary"), 256).alias("tuple_hash"), C.tuple_key(F.col("folds")).alias("tuple_key"))
