"""Queries through stores, streams and gates: what is written, read back, limited or refused."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import hmm
from ..operators import calendar, diagnostics, filtering, roles
from ..operators.evidence import EvidenceStore
from ..sources import features, panels
from ..streaming.causal import filter_stream
from .catalogue import query
from .evidence_queries import _CENTS, _cents
from .model_queries import _MOMENTS, _recursive, FEATURES, FIXED, REPLAY, _quarters, _two, scaled_days
from .oracle_panels import LINEITEM_DAILY, ORDERS_DAILY, PROB_PAIRS, with_panels
from .panel_queries import PRIORITIES, _NAMES, _names


def _folder(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(_recursive("SELECT ts, round(p0, 8) AS p0, round(p1, 8) AS p1, round(ll_inc, 7) AS ll_inc FROM f"))
def q_stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The causal filter over a stream of the panel's files, each a later part of the series, with its state kept between batches."""
    folder, rows = _folder(spark, "stream"), scaled_days(spark, sf_dir).select(F.lit("s").alias("series"), "ts", *FEATURES)
    bounds = rows.select("ts").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    middle = bounds["a"] + (bounds["b"] - bounds["a"]) / 2
    out = None
    for k, part in enumerate((rows.filter(F.col("ts") <= F.lit(middle)), rows.filter(F.col("ts") > F.lit(middle)))):
        part.coalesce(1).write.parquet(f"{folder}/in/part={k}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        q = filter_stream(stream, FIXED, FEATURES, "series").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append")
        q.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out").filter("NOT rejected")
    return out.select(F.col("time").cast("date").alias("ts"), *_two(out), F.round("ll_inc", 7).alias("ll_inc"))


@query(f"WITH {_CENTS}, l AS (SELECT fold_id AS family, (c % 3 + 1)::INT AS pc_ordinal, candidate AS source_feature, ((c % 200) - 100)::DOUBLE / 100 AS loading FROM cents) SELECT family, count(*) AS rows, round(sum(loading * loading), 7) AS squared FROM l GROUP BY 1")
def q_loadings_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadings committed to an evidence store, committed again (which changes nothing), and read back."""
    c = F.col("c")
    loading = ((c % 200) - 100).cast("double") / 100
    rows = _cents(spark, sf_dir).select(
        F.lit("fold_000").alias("fold_id"), F.lit("p").alias("profile_hash"), F.lit("b").alias("source_build_id"), F.col("fold_id").alias("family"), (c % 3 + 1).cast("int").alias("pc_ordinal"),
        F.col("candidate").alias("source_feature"), loading.alias("loading"), (loading * loading).alias("squared_loading"), F.lit(0.5).alias("explained_variance"),
    )
    store = EvidenceStore(spark, _folder(spark, "evidence"))
    if not store.commit("pca_loadings", rows) or store.commit("pca_loadings", rows):
        raise ValueError("a commit is new once")
    return store.read("pca_loadings").groupBy("family").agg(F.count("*").alias("rows"), F.round(F.sum("squared_loading"), 7).alias("squared"))


TRAIN = dt.date(1996, 1, 1), dt.date(1997, 12, 31)


@query(f"WITH {ORDERS_DAILY} SELECT count(*) AS rows, min(ts) AS first, max(ts) AS last FROM orders_daily WHERE ts BETWEEN DATE '{TRAIN[0]}' AND DATE '{TRAIN[1]}'")
def q_train_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pass the predicate which stops at any row outside TRAIN."""
    panel = panels.orders_daily(spark, sf_dir).select("ts")
    inside = calendar.train_only(panel.filter(F.col("ts").between(*[F.lit(d) for d in TRAIN])), *TRAIN)
    return inside.agg(F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(
    f"WITH {LINEITEM_DAILY} SELECT count(*) FILTER (WHERE ts >= DATE '{REPLAY[0]}') AS rows, count(*) AS internal_rows, count(*) FILTER (WHERE ts >= DATE '{REPLAY[0]}') * (220 + 48 * 2) AS bytes FROM lineitem_daily WHERE ts <= DATE '{REPLAY[1]}'"
)
def q_replay_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filtering.check_replay(panels.lineitem_daily(spark, sf_dir), *REPLAY, 2)
    return spark.createDataFrame([tuple(int(found[k]) for k in ("rows", "internal_rows", "bytes"))], "rows long, internal_rows long, bytes long")


@query(
    f"""WITH {PROB_PAIRS}, e AS (SELECT list_position(p, list_max(p)) - 1 AS d, unnest(range(3)) AS state, unnest(p) AS v FROM prob_pairs), o AS (SELECT state, avg((d = state)::INT) AS hard, avg(v) AS soft FROM e GROUP BY 1)
SELECT count(*) FILTER (WHERE hard < {diagnostics.MIN_HARD} OR soft < {diagnostics.MIN_SOFT}) = 0 AS enough FROM o"""
)
def q_occupancy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(diagnostics.occupancy_ok(panels.prob_pairs(spark, sf_dir)),)], "enough boolean")


@query(f"WITH {_MOMENTS} SELECT CASE WHEN count(*) FILTER (WHERE NOT (isfinite(l1) AND isfinite(l2))) > 0 THEN 'not_finite' WHEN min(exp(2 * least(l1, l2))) < 1e-12 THEN 'variance_too_small' WHEN max(abs(r)) >= 1 THEN 'not_positive_definite' ELSE 'accepted' END AS gate FROM s")
def q_covariance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(hmm.covariance_reason(_quarters(spark, sf_dir)) or "accepted",)], "gate string")


@query("WITH " + _NAMES + ", u AS (SELECT name FROM names UNION SELECT 'pca_pc_' || lpad(p_size::VARCHAR, 3, '0') FROM part) SELECT name FROM u WHERE NOT regexp_matches(name, '^pca_pc_[0-9]{3}$')")
def q_raw_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names a projection may be fitted on: generated components are none."""
    made = panels.table(spark, sf_dir, "part").select(F.concat(F.lit("pca_pc_"), F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("name"))
    return roles.raw_universe(_names(spark, sf_dir).union(made).distinct())


@query(
    f"{with_panels(ORDERS_DAILY)} SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT {k + 1}::BIGINT AS ordinal, '{n}' AS name, count({n}) AS present, count(*) AS rows FROM orders_daily WHERE ts BETWEEN DATE '{TRAIN[0]}' AND DATE '{TRAIN[1]}'" for k, n in enumerate([*PRIORITIES, "total", "n_orders"]))
    + ")"
)
def q_read_with_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog and rows of one snapshot, which later changes of the source don't reach."""
    source = features.SnapshotSource(panels.orders_daily(spark, sf_dir), _folder(spark, "snapshot"))
    catalog, rows = source.read_all_with_catalog(*TRAIN)
    long = rows.unpivot(["ts"], [c for c in rows.columns if c != "ts"], "name", "value")
    counts = long.groupBy("name").agg(F.count("value").alias("present"), F.count("*").alias("rows"))
    return catalog.select("ordinal", "name").join(F.broadcast(counts), "name").select("ordinal", "name", "present", "rows")
