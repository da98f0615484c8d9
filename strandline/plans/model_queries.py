"""Queries with models: fixed ones, whose filters have recursive SQL equivalents, and fits."""

from __future__ import annotations

import datetime as dt
import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..models import alignment
from ..models.hmm import FAMILIES, GAUSSIAN, HMM
from ..operators import calendar, filtering, multistart, pca, quality, selection
from ..sources import panels
from ..sources import predictions as builds
from . import refit
from .catalogue import query
from .oracle_panels import EMBEDDING_MATRIX, LINEITEM_DAILY, PROB_PAIRS
from .panel_queries import LINE_FOLDS

FEATURES = ["price", "quantity"]
START = [0.6, 0.4]
TRANSITION = [[0.95, 0.05], [0.10, 0.90]]
MEANS = [[0.3, -0.2], [-0.3, 0.4]]
COVARIANCES = [[[1.0, 0.2], [0.2, 0.8]], [[1.2, -0.1], [-0.1, 1.1]]]
FIXED = HMM(GAUSSIAN, np.array(START), np.array(TRANSITION), np.array(MEANS), np.array(COVARIANCES), log_likelihood=0.0)
CUTOFF, AS_OF = dt.date(1999, 12, 31), dt.date(2000, 6, 15)
REPLAY = (dt.date(1998, 1, 1), dt.date(1998, 6, 30))


def scaled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scaled(panels.lineitem_daily(spark, sf_dir).select("ts", *FEATURES), FEATURES)


def _density(k: int) -> str:
    """Log-density of the fixed model's state k over z1 and z2, with the closed form of a 2 x 2 inverse."""
    (a, b), (_, d) = COVARIANCES[k]
    det = a * d - b * b
    x, y = f"(z1 - ({MEANS[k][0]}))", f"(z2 - ({MEANS[k][1]}))"
    return f"-0.5 * (({d} * {x} * {x} - 2 * ({b}) * {x} * {y} + {a} * {y} * {y}) / {det!r} + {2 * math.log(2 * math.pi) + math.log(det)!r})"


_Z = f"""{LINEITEM_DAILY}, c AS (SELECT ts, price, quantity FROM lineitem_daily WHERE price IS NOT NULL AND quantity IS NOT NULL),
z AS (SELECT ts, (price - avg(price) OVER ()) / sqrt(var_pop(price) OVER ()) AS z1, (quantity - avg(quantity) OVER ()) / sqrt(var_pop(quantity) OVER ()) AS z2 FROM c),
e AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i, {_density(0)} AS e0, {_density(1)} AS e1 FROM z)"""
_W = "exp(e0 - greatest(e0, e1)) * q0 AS w0, exp(e1 - greatest(e0, e1)) * q1 AS w1, greatest(e0, e1) AS top"
_FILTER = f"""{_Z}, f(i, ts, p0, p1, ll_inc) AS (
  SELECT i, ts, w0 / (w0 + w1), w1 / (w0 + w1), top + ln(w0 + w1) FROM (SELECT i, ts, {_W} FROM (SELECT *, {START[0]}::DOUBLE AS q0, {START[1]}::DOUBLE AS q1 FROM e WHERE i = 1))
  UNION ALL
  SELECT i, ts, w0 / (w0 + w1), w1 / (w0 + w1), top + ln(w0 + w1) FROM (SELECT i, ts, {_W} FROM (SELECT e.*, f.p0 * {TRANSITION[0][0]} + f.p1 * {TRANSITION[1][0]} AS q0, f.p0 * {TRANSITION[0][1]} + f.p1 * {TRANSITION[1][1]} AS q1 FROM e JOIN f ON e.i = f.i + 1)))"""


def _recursive(select: str) -> str:
    return f"WITH RECURSIVE {_FILTER} {select}"


def _two(filtered: DataFrame) -> list:
    return [F.round(F.col("p")[k], 8).alias(f"p{k}") for k in (0, 1)]


@query(f"WITH {_Z} SELECT ts, round(e0, 7) AS e0, round(e1, 7) AS e1 FROM e")
def q_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = [F.col(f) for f in FEATURES]
    return scaled_days(spark, sf_dir).select("ts", *[F.round(C.gaussian_log_density(x, MEANS[k], COVARIANCES[k]), 7).alias(f"e{k}") for k in (0, 1)])


@query(_recursive("SELECT ts, round(p0, 8) AS p0, round(p1, 8) AS p1, round(ll_inc, 7) AS ll_inc FROM f"))
def q_forward_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filtering.forward_filter(scaled_days(spark, sf_dir), {"fixed": FIXED}, FEATURES)
    return out.select(F.col("time").alias("ts"), *_two(out), F.round("ll_inc", 7).alias("ll_inc"))


@query(
    _recursive(
        f"SELECT count(*) FILTER (WHERE ts <= DATE '{CUTOFF}') AS train_n, count(*) FILTER (WHERE ts > DATE '{CUTOFF}') AS test_n, round(sum(ll_inc) FILTER (WHERE ts > DATE '{CUTOFF}'), 5) AS ll, "
        f"round(sum(ll_inc) FILTER (WHERE ts > DATE '{CUTOFF}') / count(*) FILTER (WHERE ts > DATE '{CUTOFF}'), 7) AS ll_per_row FROM f"
    )
)
def q_predictive_ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filtering.predictive_likelihood(scaled_days(spark, sf_dir), FIXED, FEATURES, CUTOFF)
    return out.select("train_n", "test_n", F.round("ll", 5).alias("ll"), F.round("ll_per_row", 7).alias("ll_per_row"))


@query(_recursive(f"SELECT DATE '{AS_OF}' AS as_of, ts, round(p0, 8) AS p0, round(p1, 8) AS p1, (i - 1)::BIGINT AS warmup FROM f WHERE ts <= DATE '{AS_OF}' ORDER BY i DESC LIMIT 1"))
def q_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filtering.latest(scaled_days(spark, sf_dir), FIXED, FEATURES, AS_OF)
    return out.select("as_of", F.col("time").alias("ts"), *_two(out), "warmup")


@query(_recursive(f"SELECT ts, round(p0, 8) AS p0, round(p1, 8) AS p1 FROM f WHERE ts BETWEEN DATE '{REPLAY[0]}' AND DATE '{REPLAY[1]}'"))
def q_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filtering.replay(scaled_days(spark, sf_dir), FIXED, FEATURES, *REPLAY)
    return out.select(F.col("time").alias("ts"), *_two(out))


@query(_recursive("SELECT round(arg_max(p0, i), 8) AS p0, round(arg_max(p1, i), 8) AS p1, round(sum(ll_inc), 4) AS ll FROM f"))
def q_terminal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filtering.terminal_state(scaled_days(spark, sf_dir), FIXED, FEATURES)
    return out.select(*_two(out), F.round("ll", 4).alias("ll"))


@query(
    f"""WITH RECURSIVE {_FILTER}, h(h, p0, p1) AS (SELECT 0, arg_max(p0, i), arg_max(p1, i) FROM f UNION ALL
SELECT h + 1, p0 * {TRANSITION[0][0]} + p1 * {TRANSITION[1][0]}, p0 * {TRANSITION[0][1]} + p1 * {TRANSITION[1][1]} FROM h WHERE h < 10)
SELECT h::BIGINT AS h, round(p0, 8) AS p0, round(p1, 8) AS p1 FROM h"""
)
def q_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = filtering.forward_filter(scaled_days(spark, sf_dir), {"fixed": FIXED}, FEATURES).agg(F.max_by("p", "time").alias("p"))
    steps = F.array(*[F.struct(F.lit(h).cast("long").alias("h"), C.horizon(F.col("p"), TRANSITION, h).alias("p")) for h in range(11)])
    out = last.select(F.explode(steps).alias("s")).select("s.h", "s.p")
    return out.select("h", *_two(out))


LOADINGS = [[round(math.sin(0.7 * (k + 1) * (i + 1)), 6) for i in range(8)] for k in range(3)]
PCA_FIXED = pca.PCA(tuple(f"x{i + 1:02d}" for i in range(8)), (0.01,) * 8, (0.125,) * 8, tuple(map(tuple, LOADINGS)), (0.5, 0.3, 0.2))


@query(
    f"WITH {EMBEDDING_MATRIX} SELECT vec_id, " + ", ".join("round(" + " + ".join(f"((x{i + 1:02d} - 0.01) / 0.125) * ({w})" for i, w in enumerate(row)) + f", 7) AS pc_{k + 1}" for k, row in enumerate(LOADINGS)) + " FROM embedding_matrix"
)
def q_pca_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pca.transform(panels.embedding_matrix(spark, sf_dir), PCA_FIXED, "pc", ["vec_id"])
    return out.select("vec_id", *[F.round(f"pc_{k}", 7).alias(f"pc_{k}") for k in (1, 2, 3)])


#: States of known membership: the days of each quarter of the year, with the moments of scaled price and quantity.
_MOMENTS = f"""{_Z.replace("e AS (SELECT ts, row_number()", "unused AS (SELECT ts, row_number()")},
s AS (SELECT quarter(ts) - 1 AS state, avg(z1) AS m1, avg(z2) AS m2, ln(stddev_pop(z1)) AS l1, ln(stddev_pop(z2)) AS l2, corr(z1, z2) AS r FROM z GROUP BY 1)"""


def _quarters(spark: SparkSession, sf_dir: str) -> HMM:
    """A model whose states are the quarters' moments."""
    z = scaled_days(spark, sf_dir)
    x, y = (F.col(f) for f in FEATURES)
    rows = z.groupBy((F.quarter("ts") - 1).alias("state")).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy")).orderBy("state").collect()
    means = np.array([[r["mx"], r["my"]] for r in rows])
    return HMM(GAUSSIAN, np.full(len(rows), 1 / len(rows)), np.full((len(rows), len(rows)), 1 / len(rows)), means, np.array([[[r["xx"], r["xy"]], [r["xy"], r["yy"]]] for r in rows]), log_likelihood=0.0)


@query(f"WITH {_MOMENTS} SELECT state::BIGINT AS state, round(m1, 7) AS mean_1, round(m2, 7) AS mean_2, round(l1, 7) AS log_sd_1, round(l2, 7) AS log_sd_2, round(r, 7) AS corr_12 FROM s")
def q_state_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, *(round(float(v), 7) for v in s)) for k, s in enumerate(alignment.signatures(_quarters(spark, sf_dir)))]
    return spark.createDataFrame(rows, "state long, mean_1 double, mean_2 double, log_sd_1 double, log_sd_2 double, corr_12 double")


_RMS = "sqrt(((a.m1 - b.m1) ** 2 + (a.m2 - b.m2) ** 2 + (a.l1 - b.l1) ** 2 + (a.l2 - b.l2) ** 2 + (a.r - b.r) ** 2) / 5)"


@query(f"WITH {_MOMENTS} SELECT a.state::BIGINT AS i, b.state::BIGINT AS j, round({_RMS}, 7) AS rms FROM s a, s b")
def q_rms_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k, list(map(float, s))) for k, s in enumerate(alignment.signatures(_quarters(spark, sf_dir)))], "i long, v array<double>")
    other = rows.select(F.col("i").alias("j"), F.col("v").alias("w"))
    return rows.crossJoin(F.broadcast(other)).select("i", "j", F.round(C.rms_distance(F.col("v"), F.col("w")), 7).alias("rms"))  # four states


def _build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prob_pairs in the shape of an OOS build."""
    p = F.col("p")
    ids = F.array(*[F.lit(f"state_{k:03d}") for k in range(3)])
    text = lambda c, v: F.lit(v).alias(c)
    return panels.prob_pairs(spark, sf_dir).select(
        text("profile_id", "daily"), text("schema_version", "1"), text("prediction_mode", "oos"), F.col("ts").cast("timestamp").alias("timestamp"), ids.alias("state_ids"),
        p.alias("state_probabilities"), F.get(ids, C.dominant(p).cast("int")).alias("dominant_state"), C.confidence(p).alias("confidence"), C.entropy(p).alias("entropy"),
        text("candidate_id", "gaussian_k3"), text("fold_id", "fold_000"), text("evaluation_plan_hash", "0"), text("feature_selection_definition_hash", "0"), text("feature_selection_execution_hash", "0"),
    )


@query(f"WITH {PROB_PAIRS} SELECT ts, 'state_' || lpad((list_position(p, list_max(p)) - 1)::VARCHAR, 3, '0') AS dominant_state, round(list_max(p), 9) AS confidence FROM prob_pairs WHERE ts BETWEEN DATE '{REPLAY[0]}' AND DATE '{REPLAY[1]}'")
def q_oos_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = builds.oos_slice(_build(spark, sf_dir), *[dt.datetime(d.year, d.month, d.day) for d in REPLAY])
    return rows.select(F.col("timestamp").cast("date").alias("ts"), "dominant_state", F.round("confidence", 9).alias("confidence"))


@query()
def q_publish_oos(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    root = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + "/builds"
    build = uuid.uuid4().hex
    builds.publish(_build(spark, sf_dir), root, "daily", build)
    manifest, rows = builds.read(spark, root, "daily", build)
    return rows.agg(F.count("*").alias("rows")).withColumn("declared", F.lit(manifest["row_count"]).cast("long"))


@query(
    _recursive(
        f"SELECT d.fold_id, f.ts, round(f.p0, 8) AS p0, round(f.p1, 8) AS p1 FROM f JOIN folds d ON f.ts BETWEEN d.test_first AND d.test_last"
    ).replace("WITH RECURSIVE ", f"WITH RECURSIVE {LINE_FOLDS}, ").replace(f"{LINEITEM_DAILY}, c AS", "c AS")
)
def q_oos_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fold's TEST month by the fold's model, whose filter continues from its TRAIN: the rows of an out-of-sample build."""
    rows = scaled_days(spark, sf_dir)
    plan = calendar.plan_folds(panels.lineitem_daily(spark, sf_dir).select("ts"))
    folds = [r.asDict() for r in plan.orderBy("fold_id").collect()]
    out = filtering.forward_filter(rows, {"fixed": FIXED}, FEATURES)
    ends = out.join(F.broadcast(plan.select("fold_id", "train_cutoff")), F.col("time") <= F.col("train_cutoff")).groupBy("fold_id").agg(F.max_by("p", "time").alias("p"))
    alphas = {r["fold_id"]: list(r["p"]) for r in ends.collect()}
    test = calendar.fold_rows(rows, plan).filter("part = 'test'")
    found = filtering.forward_filter(test, {f["fold_id"]: FIXED for f in folds}, FEATURES, key="fold_id", alphas=alphas)
    return found.select(F.col("model").alias("fold_id"), F.col("time").alias("ts"), *_two(found))


@query(f"WITH {PROB_PAIRS} SELECT count(*) AS rows, count(*) AS declared, sum((list_position(p, list_max(p)) - 1))::BIGINT AS dominant FROM prob_pairs")
def q_build_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build written, read back and verified by checksum and row count."""
    import uuid

    root, build = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + "/builds", uuid.uuid4().hex
    builds.publish(_build(spark, sf_dir), root, "daily", build)
    manifest, rows = builds.read(spark, root, "daily", build)
    out = rows.agg(F.count("*").alias("rows"), F.sum(F.substring("dominant_state", 7, 3).cast("long")).alias("dominant"))
    return out.select("rows", F.lit(manifest["row_count"]).cast("long").alias("declared"), "dominant")


FIT_COLUMNS = ["price", "discount", "quantity"]
FIT_SEEDS = multistart.SEEDS


def _days(spark: SparkSession, sf_dir: str, columns: list[str] = FIT_COLUMNS) -> np.ndarray:
    """A fold's decision data: one row per day, bounded by the calendar whatever the scale."""
    rows = panels.lineitem_daily(spark, sf_dir).select("ts", *columns).na.drop("any", subset=columns).orderBy("ts").collect()
    return np.array([list(r[1:]) for r in rows], float)


def _fit(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    x = _days(spark, sf_dir)
    n = int(len(x) * 0.8)
    out = multistart.run(spark, x, [multistart.Job(family, (0, 1, 2), n, len(x) - n, 2, family)], FIT_SEEDS)
    return out.select("job", "seed", "ok", "reason", "ll", "test_ll", "test_n")


@query()
def q_hmm_fit_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, FAMILIES[0])


@query()
def q_hmm_fit_gmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, FAMILIES[1])


@query()
def q_hmm_fit_student_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, FAMILIES[2])


@query()
def q_multistart(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _days(spark, sf_dir)
    jobs = [multistart.Job(f"k{k}", (0, 2), len(x), 0, k) for k in (2, 3)]
    return multistart.winners(multistart.run(spark, x, jobs, FIT_SEEDS)).drop("model")


def _evaluate(spark: SparkSession, x: np.ndarray, states: int):
    n = int(len(x) * 0.8)

    def evaluate(subsets: list[tuple[str, ...]]) -> list[float | None]:
        jobs = [multistart.Job("|".join(s), tuple(FIT_COLUMNS.index(f) for f in s), n, len(x) - n, states) for s in subsets]
        found = {r["job"]: r for r in multistart.winners(multistart.run(spark, x, jobs, FIT_SEEDS)).collect()}
        base = {s: refit.single_normal(x[:, [FIT_COLUMNS.index(f) for f in s]], n, len(x) - n) for s in subsets}
        best = {s: found["|".join(s)] for s in subsets}
        return [0.5 + 0.5 * math.tanh(best[s]["test_ll"] / best[s]["test_n"] - base[s]) if best[s]["valid"] and best[s]["test_n"] else None for s in subsets]

    return evaluate


_STEPS = "k long, number long, action string, candidate string, selected string, score double"


@query()
def q_sffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.sffs(FIT_COLUMNS, _evaluate(spark, _days(spark, sf_dir), 2))
    return spark.createDataFrame([(2, s.number, s.action, s.candidate, "|".join(s.selected), s.score) for s in found.steps], _STEPS)


@query()
def q_k_sffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _days(spark, sf_dir)
    found = selection.k_slot_sffs(FIT_COLUMNS, lambda k, subsets: _evaluate(spark, x, k)(subsets))
    return spark.createDataFrame([(k, s.number, s.action, s.candidate, "|".join(s.selected), s.score) for k, f in found.items() for s in f.steps], _STEPS)


@query()
def q_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(selection.ablation(FIT_COLUMNS, _evaluate(spark, _days(spark, sf_dir), 2)), "feature string, loss double")


#: All orders of four states, the distance of each to the states of the days up to CUTOFF, and the nearest.
_ALIGNED = f"""{_Z.replace("e AS (SELECT ts, row_number()", "unused AS (SELECT ts, row_number()")},
h AS (SELECT ts <= DATE '{CUTOFF}' AS early, quarter(ts) - 1 AS state, avg(z1) AS m1, avg(z2) AS m2, ln(stddev_pop(z1)) AS l1, ln(stddev_pop(z2)) AS l2, corr(z1, z2) AS r FROM z GROUP BY 1, 2),
d AS (SELECT a.state AS source, b.state AS state, {_RMS} AS d FROM h a, h b WHERE NOT a.early AND b.early),
p AS (SELECT w.source AS a, x.source AS b, y.source AS c, z4.source AS e, w.d + x.d + y.d + z4.d AS total FROM d w, d x, d y, d z4 WHERE w.state = 0 AND x.state = 1 AND y.state = 2 AND z4.state = 3
  AND len(list_distinct([w.source, x.source, y.source, z4.source])) = 4),
best AS (SELECT * FROM p ORDER BY total LIMIT 1)"""


@query(f"WITH {_ALIGNED} SELECT unnest([0, 1, 2, 3])::BIGINT AS state, unnest([a, b, c, e])::BIGINT AS source FROM best")
def q_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarters of the days after CUTOFF, aligned to those of the days before."""
    z = scaled_days(spark, sf_dir)
    x, y = (F.col(f) for f in FEATURES)
    rows = z.groupBy((F.col("ts") <= F.lit(CUTOFF)).alias("early"), (F.quarter("ts") - 1).alias("state"))
    rows = rows.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy")).orderBy("state").collect()
    early, late = (HMM(GAUSSIAN, np.full(4, 0.25), np.full((4, 4), 0.25), np.array([[r["mx"], r["my"]] for r in half]), np.array([[[r["xx"], r["xy"]], [r["xy"], r["yy"]]] for r in half])) for half in ([r for r in rows if r["early"] == e] for e in (True, False)))
    order = alignment.to_reference(late, alignment.signatures(early))
    return spark.createDataFrame([(k, int(o)) for k, o in enumerate(order)], "state long, source long")


_TWO = {"size": ["price", "quantity"], "rate": ["discount", "tax"]}


def _two_sql() -> str:
    """Of two standardised features the components are (1, 1) and (1, -1) over the root of two, the first by the sign of their correlation."""
    parts = [
        f"SELECT '{n}' AS family, '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS r FROM lineitem_daily WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for n, (a, b) in _TWO.items()
    ]
    return f"{LINEITEM_DAILY}, c AS ({' UNION ALL '.join(parts)}), k AS (SELECT *, unnest([1, 2]) AS k FROM c), l AS (SELECT *, unnest([f1, f2]) AS f FROM k)"


@query(
    f"WITH {_two_sql()} SELECT family, k::BIGINT AS pc_ordinal, f AS source_feature, round(CASE WHEN f = f1 OR (k = 1) = (r > 0) THEN 1 ELSE -1 END * sqrt(0.5), 7) AS loading, "
    "round((1 + CASE WHEN k = 1 THEN abs(r) ELSE -abs(r) END) / 2, 7) AS explained_variance FROM l"
)
def q_pca_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted projections of families of two, which have a closed form."""
    found = pca.fit_families(panels.lineitem_daily(spark, sf_dir), _TWO, strict=True)
    rows = [(n, k, f, round(w, 7), round(e, 7)) for n, p in found.items() for k, f, w, _, e in p.loadings()]
    # Which of two loadings of equal size is first for the sign: by name, as the operator has it.
    return spark.createDataFrame(rows, "family string, pc_ordinal long, source_feature string, loading double, explained_variance double")


@query()
def q_family_pca_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panels.embedding_matrix(spark, sf_dir)
    families = {f"block_{b + 1}": [f"x{8 * b + i + 1:02d}" for i in range(8)] for b in range(8)}
    rows = [(name, *r) for name, fit in pca.fit_families(panel, families, strict=True).items() for r in fit.loadings()]
    return spark.createDataFrame(rows, "family string, pc_ordinal long, source_feature string, loading double, squared_loading double, explained_variance double")


@query()
def q_final_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refit's filter after its last day, or the gate's reason for deploying no model (alpha is then NULL), with the states' shares of the days."""
    try:
        found = refit.final_refit(spark, panels.lineitem_daily(spark, sf_dir), ["price", "quantity"], 2)
    except refit.Rejected as e:
        found = e.known | {"reason": str(e)}
    last = found["trained_through"]
    row = (json.dumps(found["features"]), found["rows"], None if last is None else str(last), *[found.get(k) for k in ("alpha", "reason", "hard", "soft")])
    return spark.createDataFrame([row], "features string, rows long, trained_through string, alpha array<double>, reason string, hard array<double>, soft array<double>")
