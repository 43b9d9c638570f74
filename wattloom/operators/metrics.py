"""Regression, calibration and interval metrics, each one partial aggregate."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom import constants as K
from wattloom.functions import code_map, finite
from wattloom.operators.quantiles import order_statistics


def _grouped(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by) if by else df.groupBy()


def regression_metrics(df: DataFrame, y: str, pred: str, weight: str | None = None,
                       by: Sequence[str] = (), min_rows: int = 10) -> DataFrame:
    """n, R2, RMSE, MAE, NMBE %, CV(RMSE) % and (with ``weight``) weighted R2.

    Rows without a finite pair are left out; scores are NULL below ``min_rows``.
    """
    pairs = df.select(*by, finite(F.col(y).cast("double")).alias("_y"),
                      finite(F.col(pred).cast("double")).alias("_p"),
                      (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    pairs = pairs.filter(F.col("_y").isNotNull() & F.col("_p").isNotNull())
    yv, pv, w = F.col("_y"), F.col("_p"), F.col("_w")
    err2 = (yv - pv) * (yv - pv)
    g = _grouped(pairs, by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(yv).alias("_my"), F.avg(pv).alias("_mp"),
        F.avg(err2).alias("_mse"), F.var_pop(yv).alias("_var"), F.avg(F.abs(yv - pv)).alias("_mae"),
        F.sum(w).alias("_sw"), F.sum(w * yv).alias("_swy"), F.sum(w * yv * yv).alias("_swyy"),
        F.sum(w * err2).alias("_swe"))
    enough = F.col("n") >= min_rows
    scale = F.greatest(F.abs(F.col("_my")), F.lit(1e-9))
    rmse = F.sqrt(F.col("_mse"))
    wvar = F.col("_swyy") - F.col("_swy") * F.col("_swy") / F.col("_sw")
    out = [
        (1 - F.try_divide(F.col("_mse"), F.col("_var"))).alias("r2"),
        rmse.alias("rmse"), F.col("_mae").alias("mae"),
        (100 * (F.col("_mp") - F.col("_my")) / scale).alias("nmbe_pct"),
        (100 * rmse / scale).alias("cvrmse_pct")]
    if weight:
        out.append((1 - F.when(wvar > 0, F.col("_swe") / wvar)).alias("r2_weighted"))
    g = g.select(*by, "n", *out)
    scores = [c for c in g.columns if c not in {*by, "n"}]
    return g.select(*by, "n", *[F.when(enough, F.col(c)).alias(c) for c in scores])


def interval_coverage(df: DataFrame, y: str, lo: str, hi: str, by: Sequence[str] = (),
                      min_rows: int = 10) -> DataFrame:
    """Share of targets inside inclusive bounds, and the mean width; NULL below ``min_rows``."""
    ok = df.select(*by, *[finite(F.col(c).cast("double")).alias(n)
                          for c, n in ((y, "_y"), (lo, "_l"), (hi, "_h"))]).dropna(subset=["_y", "_l", "_h"])
    g = _grouped(ok, by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("_y").between(F.col("_l"), F.col("_h")).cast("double")).alias("coverage"),
        F.avg(F.col("_h") - F.col("_l")).alias("mean_width"))
    return g.select(*by, "n", *[F.when(F.col("n") >= min_rows, F.col(c)).alias(c) for c in ("coverage", "mean_width")])


def population_calibration(df: DataFrame, y: str, pred: str, weight: str, by: Sequence[str] = (),
                           min_rows: int = 10) -> DataFrame:
    """Weighted totals of truth and prediction, and their gap in percent; NULL below ``min_rows``."""
    ok = df.select(*by, *[finite(F.col(c).cast("double")).alias(n)
                          for c, n in ((y, "_y"), (pred, "_p"), (weight, "_w"))]).dropna(subset=["_y", "_p", "_w"])
    g = _grouped(ok, by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_y") * F.col("_w")).alias("weighted_total_true"),
        F.sum(F.col("_p") * F.col("_w")).alias("weighted_total_pred"))
    t, p = F.col("weighted_total_true"), F.col("weighted_total_pred")
    g = g.withColumn("calibration_error_pct", 100 * (p - t) / F.greatest(t, F.lit(1e-9)))
    scores = ("weighted_total_true", "weighted_total_pred", "calibration_error_pct")
    return g.select(*by, "n", *[F.when(F.col("n") >= min_rows, F.col(c)).alias(c) for c in scores])


# ---- conformal intervals ------------------------------------------------------

def conformal_rank(n: int, alpha: float) -> int:
    """One-based rank of the split-conformal quantile, capped at ``n``."""
    return min(math.ceil((n + 1) * (1 - alpha)), n)


def conformal_quantiles(df: DataFrame, residual: str | Column,
                        alphas: Sequence[float] = (K.ALPHA,), min_rows: int = 50) -> tuple[dict[float, float | None], int]:
    """Exact half-widths per level from absolute calibration residuals."""
    r = F.abs(F.col(residual) if isinstance(residual, str) else residual)
    found, n = order_statistics(df, {"r": r}, lambda _, m: [conformal_rank(m, a) - 1 for a in alphas])
    n = n["r"]
    if n < min_rows:
        return dict.fromkeys(alphas), n
    return {a: found["r"][conformal_rank(n, a) - 1] for a in alphas}, n


def conformal_bounds(df: DataFrame, log_pred: str, q: float, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Interval on the energy scale from a log-scale half-width, floored at zero."""
    mu = F.col(log_pred)
    return df.withColumns({lo: F.greatest(F.expm1(mu - F.lit(q)), F.lit(0.0)),
                           hi: F.expm1(mu + F.lit(q))})


def coverage_curve(df: DataFrame, y_log: str, pred_log: str, widths: Mapping[float, float],
                   tolerance_pp: float = K.COVERAGE_TOLERANCE_PP) -> DataFrame:
    """Observed coverage per nominal level on evaluation rows, one scan."""
    y, mu = finite(y_log), finite(pred_log)
    ok = y.isNotNull() & mu.isNotNull()
    levels = sorted(widths, reverse=True)
    row = df.filter(ok).agg(F.count(F.lit(1)).alias("n"), *[
        F.avg(F.col(y_log).between(F.col(pred_log) - F.lit(widths[a]), F.col(pred_log) + F.lit(widths[a]))
              .cast("double")).alias(f"c{i}") for i, a in enumerate(levels)])
    out = row.select("n", F.inline(F.array(*[
        F.struct(F.lit(round(1 - a, 3)).alias("nominal"), F.lit(float(widths[a])).alias("q"),
                 F.col(f"c{i}").alias("observed")) for i, a in enumerate(levels)])))
    return out.withColumn("warn", F.abs(F.col("observed") - F.col("nominal")) * 100 > tolerance_pp)


# ---- scores over seeds --------------------------------------------------------

def _t_cdf(t: float, df: int) -> float:
    """Student-t distribution function for whole degrees of freedom (finite series)."""
    theta = math.atan(t / math.sqrt(df))
    c2 = math.cos(theta) ** 2
    if df % 2:
        term, total = math.cos(theta), 0.0
        for j in range(1, (df - 1) // 2 + 1):
            total += term
            term *= c2 * (2 * j) / (2 * j + 1)
        area = 2 / math.pi * (theta + (math.sin(theta) * total if df > 1 else 0.0))
    else:
        term, total = 1.0, 0.0
        for j in range(1, df // 2 + 1):
            total += term
            term *= c2 * (2 * j - 1) / (2 * j)
        area = math.sin(theta) * total
    return 0.5 + area / 2


@lru_cache(maxsize=None)
def t_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def _half_width(n: Column, sd: Column, max_n: int = 120) -> Column:
    """95 % half-width; a normal quantile with its first correction beyond the table."""
    z = 1.959963984540054
    table = {k: t_quantile(0.975, k - 1) for k in range(2, max_n + 1)}
    beyond = F.lit(z) + (z ** 3 + z) / (4 * (n - 1))
    t = F.coalesce(code_map(n.cast("double"), table), beyond)
    return F.when(n > 1, t * sd / F.sqrt(n)).otherwise(0.0)


def summarise_scores(scores: DataFrame, score: str = "score", by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean, sd, 95 % t interval, min and max of per-seed scores."""
    g = (scores.select(*by, finite(F.col(score).cast("double")).alias("_s")).groupBy(*by)
         .agg(F.count("_s").alias("n"), F.avg("_s").alias("mean"),
              F.coalesce(F.stddev_samp("_s"), F.lit(0.0)).alias("sd"),
              F.min("_s").alias("min"), F.max("_s").alias("max")))
    half = _half_width(F.col("n"), F.col("sd"))
    return g.withColumns({"ci95_lo": F.col("mean") - half, "ci95_hi": F.col("mean") + half})


def paired_verdict(pairs: DataFrame, a: str, b: str, by: Sequence[str] = (),
                   threshold_pp: float = K.EFFECT_THRESHOLD_PP) -> DataFrame:
    """Per-seed difference a - b in points, its interval, sign count and verdict."""
    d = (F.col(a) - F.col(b)) * 100.0
    g = _grouped(pairs.select(*by, d.alias("_d")).filter(F.col("_d").isNotNull()), by).agg(
        F.count("_d").alias("n"), F.avg("_d").alias("mean_pp"),
        F.coalesce(F.stddev_samp("_d"), F.lit(0.0)).alias("sd_pp"),
        F.count_if(F.col("_d") > 0).alias("n_positive"))
    half = _half_width(F.col("n"), F.col("sd_pp"))
    g = g.withColumns({"ci95_lo_pp": F.col("mean_pp") - half, "ci95_hi_pp": F.col("mean_pp") + half})
    return g.withColumns({
        "sign_consistency": F.concat_ws("/", F.col("n_positive").cast("string"), F.col("n").cast("string")),
        "verdict": F.when(F.col("ci95_lo_pp") > threshold_pp, "consistent_gain")
        .when(F.col("ci95_hi_pp") < threshold_pp, "no_measurable_gain").otherwise("within_noise"),
        "threshold_pp": F.lit(threshold_pp)}).drop("n_positive")


def best_of(df: DataFrame, columns: Sequence[str], target: str = "best") -> DataFrame:
    """Row-wise best baseline; NULL scores are ignored."""
    return df.withColumn(target, F.greatest(*columns) if len(columns) > 1 else F.col(columns[0]))
