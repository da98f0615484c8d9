"""Scalar functions as column expressions: all stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_CONFIDENCE = 0.60
DAYS_PER_YEAR = 365.2425
# Weights of the score's parts and of robustness's parts.
SCORE_WEIGHTS = {"forecast": 0.50, "calibration": 0.20, "stability": 0.20, "robustness": 0.10}
ROBUSTNESS_WEIGHTS = {"rate": 0.50, "worst": 0.25, "support": 0.25}
# Freshness limits in days.
FRESHNESS = {"loader_warn": 4, "loader_fail": 14, "data_warn": 7, "data_fail": 35}


def entropy(p: Column) -> Column:
    """Natural entropy with 0 ln 0 = 0."""
    return F.aggregate(p, F.lit(0.0), lambda acc, v: acc + F.when(v > 0, -v * F.ln(v)).otherwise(0.0))


def confidence(p: Column) -> Column:
    return F.array_max(p)


def dominant(p: Column) -> Column:
    """Position from 0 of the largest probability, the first of equal ones."""
    return F.array_position(p, F.array_max(p)) - 1


def normalised(p: Column, tolerance: float = 1e-10) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda acc, v: acc + v)
    return (F.abs(total - 1) <= tolerance) & F.forall(p, lambda v: (v >= 0) & (v <= 1))


def local_month(ts: Column, zone: str = "Europe/Berlin") -> Column:
    """First day of the local month."""
    return F.trunc(F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("date"), "month")


def elapsed_days(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86_400e6)


def standardised(x: Column, mean: Column, scale: Column) -> Column:
    return (x - mean) / scale


def gaussian_parameters(k: Column, d: Column) -> Column:
    """Start, transition, means and full covariances."""
    return k - 1 + k * (k - 1) + k * d + (k * d * (d + 1) / 2).cast("long")


def mixture_parameters(k: Column, d: Column, m: Column) -> Column:
    return k - 1 + k * (k - 1) + k * (m - 1) + k * m * d + (k * m * d * (d + 1) / 2).cast("long")


def aic(log_likelihood: Column, parameters: Column) -> Column:
    return 2 * parameters - 2 * log_likelihood


def bic(log_likelihood: Column, parameters: Column, n: Column) -> Column:
    return parameters * F.ln(n) - 2 * log_likelihood


def forecast_score(target: Column, baseline: Column) -> Column:
    return 0.5 + 0.5 * F.tanh(target - baseline)


def total_score(forecast: Column, calibration: Column, stability: Column, robustness: Column) -> Column:
    w = SCORE_WEIGHTS
    return w["forecast"] * forecast + w["calibration"] * calibration + w["stability"] * stability + w["robustness"] * robustness


def robustness(rate: Column, worst: Column, support: Column) -> Column:
    w = ROBUSTNESS_WEIGHTS
    return w["rate"] * rate + w["worst"] * worst + w["support"] * support


def tuple_key(names: Column) -> Column:
    return F.array_join(names, "|")


def content_hash(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)


def is_sha256(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def is_trimmed(text: Column) -> Column:
    return (text != "") & (F.trim(text) == text)


def permuted(p: Column, order: list[int]) -> Column:
    return F.array(*[p[k] for k in order])


def rms_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v) / F.size(a))


def horizon(p: Column, transition: list[list[float]], steps: int) -> Column:
    """p times the transition matrix, steps times."""
    k = len(transition)

    def once(v: Column, _: Column) -> Column:
        return F.array(*[sum((v[i] * transition[i][j] for i in range(k)), F.lit(0.0)) for j in range(k)])

    return p if steps == 0 else F.aggregate(F.sequence(F.lit(1), F.lit(steps)), p, once)


def gaussian_log_density(x: list[Column], mean: list[float], cov: list[list[float]]) -> Column:
    """Log-density of a full-covariance normal; the inverse and determinant are constants of the plan."""
    import numpy as np

    precision, (_, logdet) = np.linalg.inv(np.array(cov)), np.linalg.slogdet(np.array(cov))
    d = len(mean)
    z = [x[i] - mean[i] for i in range(d)]
    form = sum((z[i] * z[j] * float(precision[i, j]) for i in range(d) for j in range(d)), F.lit(0.0))
    return -0.5 * (form + (d * math.log(2 * math.pi) + float(logdet)))


def student_t_log_density(x: list[Column], mean: list[float], scale: list[list[float]], nu: float) -> Column:
    import numpy as np

    precision, (_, logdet) = np.linalg.inv(np.array(scale)), np.linalg.slogdet(np.array(scale))
    d = len(mean)
    z = [x[i] - mean[i] for i in range(d)]
    form = sum((z[i] * z[j] * float(precision[i, j]) for i in range(d) for j in range(d)), F.lit(0.0))
    constant = math.lgamma((nu + d) / 2) - math.lgamma(nu / 2) - 0.5 * (d * math.log(nu * math.pi) + float(logdet))
    return F.lit(constant) - (nu + d) / 2 * F.log1p(form / nu)


def log_sum_exp(values: list[Column]) -> Column:
    top = F.greatest(*values)
    return top + F.ln(sum((F.exp(v - top) for v in values[1:]), F.exp(values[0] - top)))


def freshness(days: Column, warn: int, fail: int) -> Column:
    return F.when(days > fail, "failed").when(days > warn, "degraded").otherwise("fresh")
