"""Peak-profile maths and quality labels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2.0)

# Bit flags of a rejected fit and the relative-misfit limit.
FLAG_OK = 0
FLAG_LOW_AMPLITUDE = 1
FLAG_BAD_CHI2 = 2
FLAG_CENTER_DRIFT = 4
FLAG_WIDTH_BOUND = 8
FLAG_NO_CONVERGENCE = 16
MAX_REL_MISFIT = 0.05

# Detection presets.
SENSITIVITY = {
    "conservative": {"min_snr": 6.0, "min_prominence_snr": 3.0, "min_fwhm_bins": 3.0, "edge_bins": 6},
    "normal": {"min_snr": 5.0, "min_prominence_snr": 2.0, "min_fwhm_bins": 2.0, "edge_bins": 5},
    "sensitive": {"min_snr": 3.5, "min_prominence_snr": 1.5, "min_fwhm_bins": 2.0, "edge_bins": 4},
}


def resolve_sensitivity(preset: str | None = "normal", **explicit) -> dict:
    """Preset values, each overridden by an explicit one; unknown presets mean normal."""
    name = (preset or "normal").strip().lower()
    name = name if name in SENSITIVITY else "normal"
    knobs = {**SENSITIVITY[name], **{k: v for k, v in explicit.items() if v is not None}}
    knobs["edge_bins"] = int(round(knobs["edge_bins"]))
    return {**knobs, "preset": name}


def pseudo_voigt(x: Column, center: Column, amplitude: Column, fwhm: Column, eta: Column) -> Column:
    z = F.pow(2 * (x - center) / fwhm, 2)
    return amplitude * (eta / (1 + z) + (1 - eta) * F.exp(-LN2 * z))


def pseudo_voigt_area(amplitude: Column, fwhm: Column, eta: Column) -> Column:
    lorentz = 0.5 * math.pi * fwhm
    gauss = math.sqrt(math.pi / (4 * LN2)) * fwhm
    return amplitude * (eta * lorentz + (1 - eta) * gauss)


def quality_tier(flag: Column, rel_misfit: Column, limit: float = MAX_REL_MISFIT) -> Column:
    return (F.when(flag != FLAG_OK, "reject")
            .when(rel_misfit <= limit, "quantitative")
            .otherwise("position"))


def resolution_fwhm(q: Column, c2, c1, c0) -> Column:
    """Width in q of the resolution curve FWHM^2 = c2 q^2 + c1 q + c0."""
    return F.sqrt(F.greatest(c2 * q * q + c1 * q + c0, F.lit(1e-8)))


def fwhm_in_d(d: Column, fwhm_q: Column) -> Column:
    """Constant or q-dependent width in q expressed in d at that d."""
    return d * d * fwhm_q / (2 * math.pi)


def lls(y: Column) -> Column:
    """Log-log-sqrt compression of a non-negative intensity."""
    return F.log(F.log(F.sqrt(F.greatest(y, F.lit(0.0)) + 1) + 1) + 1)


def lls_inverse(z: Column) -> Column:
    return F.pow(F.exp(F.exp(z) - 1) - 1, 2) - 1


def bounded_log_squared(z: Column, epsilon: Column) -> Column:
    """log1p(z^2/eps)/log1p(1/eps) clipped to [0, 1] and exactly 1 at |z| >= 1."""
    scaled = F.log1p(z * z / epsilon) / F.log1p(1 / epsilon)
    return (F.when(z.isNull(), F.lit(None).cast("double")).when(F.abs(z) >= 1, F.lit(1.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))))


def location_similarity(a: Column, b: Column, tolerance: float) -> Column:
    if not tolerance > 0:
        raise ValueError("tolerance must be positive")
    return F.when(a.isNotNull() & b.isNotNull(),
                  F.greatest(F.lit(0.0), 1 - F.abs(a - b) / tolerance))


def relative_similarity(a: Column, b: Column) -> Column:
    """min/max of two non-negative features; two zeros share nothing."""
    usable = (a >= 0) & (b >= 0)
    return (F.when(usable & (F.greatest(a, b) == 0), F.lit(0.0))
            .when(usable, F.try_divide(F.least(a, b), F.greatest(a, b))))


def pressure_window(sigma: Column, default: float, k: float = 2.0, floor: float = 0.3) -> Column:
    known = F.when(sigma > 0, k * sigma)
    return F.greatest(F.coalesce(known, F.lit(float(default))), F.lit(float(floor)))


def prior_penalty(pressure: Column, prior: Column, window: Column) -> Column:
    """Gaussian fall-off of a fitted pressure from a prior; 1 without prior or window."""
    return F.coalesce(F.when(window > 0, F.exp(-0.5 * F.pow((pressure - prior) / window, 2))), F.lit(1.0))


def confidence(recall: Column, precision: Column, matched: Column, *, min_matched: int = 3,
               prior_penalty: Column | None = None, intensity_corr: Column | None = None,
               intensity_k: float = 0.0) -> Column:
    """F1(recall, precision) x evidence x prior x soft intensity agreement."""
    def unit(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    r, p = F.greatest(F.lit(0.0), recall), F.greatest(F.lit(0.0), precision)
    balanced = F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(0.0)
    evidence = F.least(F.lit(1.0), F.greatest(F.lit(0), matched) / float(max(1, min_matched)))
    out = balanced * evidence
    if prior_penalty is not None:
        out = out * unit(prior_penalty)
    if intensity_corr is not None and intensity_k > 0:
        k = min(1.0, intensity_k)
        out = out * F.coalesce(1 - k * (1 - unit(intensity_corr)), F.lit(1.0))
    return out
