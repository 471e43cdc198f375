"""Size and strain lines, resolution curve and other closed-form fits by sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import exact_quantiles


def williamson_hall(peaks: DataFrame, by: Sequence[str] = ("frame",), *, k_shape: float = 0.9,
                    min_peaks: int = 5, instrument: float | None = None) -> DataFrame:
    """Weighted line ``dq = 2 pi K / D + 2 eps q`` per frame, from sums alone.

    ``peaks`` carries ``q, dq, dq_err`` of good peaks.
    """
    by = list(by)
    dq = F.col("dq") if instrument is None else F.sqrt(F.greatest(F.col("dq") ** 2 - instrument ** 2, F.lit(0.0)))
    rows = peaks.withColumn("dq", dq).where(F.col("dq") > 0).withColumn(
        "w", F.when(F.col("dq_err") > 0, 1 / F.col("dq_err")).otherwise(1.0))
    w2, x, y = F.col("w") ** 2, F.col("q"), F.col("dq")
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.max("w").alias("wm"),
        F.sum(w2).alias("s0"), F.sum(w2 * x).alias("sx"), F.sum(w2 * x * x).alias("sxx"),
        F.sum(w2 * y).alias("sy"), F.sum(w2 * x * y).alias("sxy"), F.sum(w2 * y * y).alias("syy"),
        F.avg(y).alias("my"), F.avg(x).alias("mx"), F.var_pop(y).alias("vy"), F.var_pop(x).alias("vx"),
        F.covar_pop(x, y).alias("cxy")).where(F.col("n") >= min_peaks)
    det = F.col("s0") * F.col("sxx") - F.col("sx") ** 2
    line = sums.withColumn("det", det).withColumn(
        "b1", F.try_divide(F.col("s0") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("det"))).withColumn(
        "b0", F.try_divide(F.col("sy") - F.col("b1") * F.col("sx"), F.col("s0")))
    ss_w = F.greatest(F.col("syy") - F.col("b0") * F.col("sy") - F.col("b1") * F.col("sxy"), F.lit(0.0))
    s2 = ss_w / F.greatest(F.col("n") - 2, F.lit(1))
    e0 = F.sqrt(F.try_divide(F.col("sxx"), F.col("det")) * s2)
    e1 = F.sqrt(F.try_divide(F.col("s0"), F.col("det")) * s2)
    # plain residual sum about the weighted line, from central moments
    bias = F.col("my") - F.col("b0") - F.col("b1") * F.col("mx")
    ss = F.col("vy") - 2 * F.col("b1") * F.col("cxy") + F.col("b1") ** 2 * F.col("vx") + bias * bias
    size = F.when(F.col("b0") > 0, 2 * math.pi * k_shape / F.col("b0")).otherwise(float("inf"))
    return line.select(
        *by, F.col("n").alias("n_peaks"), size.alias("size"),
        F.when(F.col("b0") > 0, size * e0 / F.col("b0")).alias("size_err"),
        (F.greatest(F.col("b1"), F.lit(0.0)) / 2).alias("strain"), (e1 / 2).alias("strain_err"),
        (1 - F.try_divide(ss, F.col("vy"))).alias("r2"))


def estimate_fwhm(peaks: DataFrame, by: Sequence[str] = (), min_peaks: int = 5) -> DataFrame:
    """Median width in q, null below ``min_peaks``."""
    return exact_quantiles(peaks, "dq", [0.5], by).select(
        *by, F.col("n"), F.when((F.col("n") >= min_peaks) & (F.col("q0") > 0), F.col("q0")).alias("fwhm_q"))


def solve3(m: list[list[Column]], v: list[Column]) -> list[Column]:
    """Cramer's rule for a symmetric 3x3 system of columns; null when singular."""
    def det(a):
        return (a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1])
                - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0])
                + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0]))
    whole = det(m)
    return [F.try_divide(det([[v[r] if c == k else m[r][c] for c in range(3)] for r in range(3)]), whole)
            for k in range(3)]


def resolution_curve(peaks: DataFrame, by: Sequence[str] = (), *, min_peaks: int = 12,
                     min_span: float = 0.4) -> DataFrame:
    """Quadratic ``FWHM^2(q)`` per group with the gates that make it usable.

    The curve must stay within 0.3x to 3x of the median width over 32 probes.
    """
    by = list(by)
    # Centring and scaling q keeps the normal equations well conditioned.
    q, y = F.col("q"), F.col("dq") ** 2
    frame = peaks.groupBy(*by).agg(F.avg("q").alias("qm"), F.coalesce(F.nullif(F.stddev_pop("q"), F.lit(0.0)), F.lit(1.0)).alias("qs"),
                                   F.min("q").alias("q_lo"), F.max("q").alias("q_hi"))
    if by:
        rows = peaks.join(frame, by)
    else:
        rows = peaks.withColumn("_f", frame.select(F.struct("qm", "qs", "q_lo", "q_hi")).scalar()).select("*", "_f.*")
    t = (q - F.col("qm")) / F.col("qs")
    sums = rows.groupBy(*by, "qm", "qs", "q_lo", "q_hi").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(t ** k).alias(f"t{k}") for k in range(1, 5)],
        *[F.sum(y * t ** k).alias(f"y{k}") for k in range(3)])
    p = [F.col("n"), *[F.col(f"t{k}") for k in range(1, 5)]]
    a0, a1, a2 = solve3([[p[r + c] for c in range(3)] for r in range(3)], [F.col(f"y{k}") for k in range(3)])
    fit = sums.select(*by, "n", "q_lo", "q_hi", "qm", "qs", a0.alias("a0"), a1.alias("a1"), a2.alias("a2"))
    s, m = F.col("qs"), F.col("qm")
    coeffs = fit.withColumn("c2", F.col("a2") / (s * s)).withColumn(
        "c1", F.col("a1") / s - 2 * F.col("a2") * m / (s * s)).withColumn(
        "c0", F.col("a0") - F.col("a1") * m / s + F.col("a2") * m * m / (s * s))
    medians = exact_quantiles(peaks, "dq", [0.5], by).select(*by, F.col("q0").alias("median"))
    coeffs = coeffs.join(medians, by) if by else coeffs.withColumn("median", medians.scalar())
    probe = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.sqrt(F.greatest(
        F.col("c2") * F.pow(F.col("q_lo") + i * (F.col("q_hi") - F.col("q_lo")) / 31, 2)
        + F.col("c1") * (F.col("q_lo") + i * (F.col("q_hi") - F.col("q_lo")) / 31) + F.col("c0"), F.lit(1e-8))))
    ok = ((F.col("n") >= min_peaks) & (F.col("median") > 0)
          & (F.col("q_hi") - F.col("q_lo") >= min_span * F.col("q_hi"))
          & (F.array_min(probe) >= 0.3 * F.col("median")) & (F.array_max(probe) <= 3 * F.col("median")))
    return coeffs.select(*by, "n", "c2", "c1", "c0", "median", F.coalesce(ok, F.lit(False)).alias("ok"))
