"""Radial-axis conversions as column expressions.

``unit`` is a run attribute known when the plan is built; ``wavelength`` (in
angstrom) may be a number or a column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of the axis unit.
Q_ANGSTROM = ("q_a^-1", "q_a-1", "q_a", "q")
Q_NANOMETRE = ("q_nm^-1", "q_nm-1", "q_nm")
TWO_THETA_DEG = ("2th_deg",)
TWO_THETA_RAD = ("2th_rad",)



def _null() -> Column:
    return F.lit(None).cast("double")


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(None if value is None else float(value)).cast("double")


def axis_kind(unit: str) -> str:
    u = (unit or "").strip().lower()
    for kind, names in (("q", Q_ANGSTROM), ("q_nm", Q_NANOMETRE),
                        ("2th_deg", TWO_THETA_DEG), ("2th_rad", TWO_THETA_RAD)):
        if u in names:
            return kind
    raise ValueError(f"unknown radial unit {unit!r}")


def _needs_wavelength(kind: str, wavelength) -> None:
    if kind.startswith("2th") and (wavelength is None
                                   or (not isinstance(wavelength, Column) and wavelength <= 0)):
        raise ValueError("two-theta axes need a positive wavelength")


def _theta(center: Column, kind: str) -> Column:
    return F.radians(center) / 2 if kind == "2th_deg" else center / 2


def radial_to_d(center: Column, unit: str, wavelength=None) -> Column:
    """d-spacing of a position on the radial axis; null at a zero position."""
    kind = axis_kind(unit)
    _needs_wavelength(kind, wavelength)
    if kind == "q":
        return F.try_divide(F.lit(2 * math.pi), center)
    if kind == "q_nm":
        return F.try_divide(F.lit(2 * math.pi), center * 0.1)
    return F.try_divide(_col(wavelength), 2 * F.sin(_theta(center, kind)))


def radial_error_to_d_error(center: Column, error: Column, unit: str, wavelength=None) -> Column:
    """1-sigma of d from 1-sigma of the position; null unless positive."""
    kind = axis_kind(unit)
    if kind in ("q", "q_nm"):
        out = radial_to_d(center, unit) * F.try_divide(error, center)
    elif wavelength is None:
        return _null()
    else:
        spread = F.radians(error) if kind == "2th_deg" else error
        out = F.try_divide(radial_to_d(center, unit, wavelength),
                           F.tan(_theta(center, kind))) * spread / 2
    return F.when(F.abs(out) > 0, F.abs(out))


def d_to_radial(d: Column, unit: str, wavelength=None) -> Column:
    """Position on the radial axis of a d-spacing."""
    kind = axis_kind(unit)
    _needs_wavelength(kind, wavelength)
    if kind == "q":
        return F.try_divide(F.lit(2 * math.pi), d)
    if kind == "q_nm":
        return F.try_divide(F.lit(2 * math.pi), d) * 10.0
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(_col(wavelength), 2 * d)))
    two_theta = 2 * F.asin(sine)
    return F.degrees(two_theta) if kind == "2th_deg" else two_theta


def radial_to_two_theta(center: Column, unit: str, wavelength=None) -> Column:
    """Two-theta in degrees; null when the axis cannot be converted."""
    kind = axis_kind(unit)
    if kind == "2th_deg":
        return center
    if kind == "2th_rad":
        return F.degrees(center)
    if wavelength is None:
        return _null()
    q = center if kind == "q" else center * 0.1
    sine = _col(wavelength) * q / (4 * math.pi)
    return F.degrees(2 * F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine))))


def to_q(center: Column, unit: str, wavelength=None) -> Column:
    """q in inverse angstrom."""
    kind = axis_kind(unit)
    _needs_wavelength(kind, wavelength)
    if kind == "q":
        return center
    if kind == "q_nm":
        return center * 0.1
    return F.lit(4 * math.pi) / _col(wavelength) * F.sin(_theta(center, kind))


def width_to_q(center: Column, width: Column, unit: str, wavelength=None) -> Column:
    """A width on the radial axis expressed in q at that position."""
    kind = axis_kind(unit)
    _needs_wavelength(kind, wavelength)
    if kind == "q":
        return width
    if kind == "q_nm":
        return width * 0.1
    spread = F.radians(width) if kind == "2th_deg" else width
    return F.lit(2 * math.pi) / _col(wavelength) * F.cos(_theta(center, kind)) * spread


def wavelength_from_geometry(text: Column) -> Column:
    """Wavelength in angstrom out of a geometry text that stores metres."""
    found = F.regexp_extract(text, r"(?i)wavelength\s*:\s*([0-9eE.+-]+)", 1)
    value = found.try_cast("double")
    return F.when((value > 0) & (value < 1e-6), value * 1e10).otherwise(value)


def circular_difference(a: Column, b: Column) -> Column:
    """Shortest angular distance in degrees."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def inverse_d_squared(h: Column, k: Column, l: Column, lattice: Column) -> Column:
    """1/d^2 of a reflection in a general (triclinic) cell, closed form.

    ``lattice`` is a struct with a, b, c and alpha, beta, gamma in degrees.
    """
    def or_else(x: Column, default: Column) -> Column:
        return F.when(F.coalesce(x, F.lit(0.0)) != 0, x).otherwise(default)

    a = lattice["a"]
    b, c = or_else(lattice["b"], a), or_else(lattice["c"], a)
    ca, cb, cg = (F.cos(F.radians(or_else(lattice[n], F.lit(90.0))))
                  for n in ("alpha", "beta", "gamma"))
    sa2, sb2, sg2 = 1 - ca * ca, 1 - cb * cb, 1 - cg * cg
    cell = 1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg
    numerator = ((h * h) * sa2 / (a * a) + (k * k) * sb2 / (b * b) + (l * l) * sg2 / (c * c)
                 + 2 * h * k * (ca * cb - cg) / (a * b)
                 + 2 * k * l * (cb * cg - ca) / (b * c)
                 + 2 * h * l * (ca * cg - cb) / (a * c))
    return F.try_divide(numerator, cell)


def d_from_lattice(h: Column, k: Column, l: Column, lattice: Column) -> Column:
    inv = inverse_d_squared(h, k, l, lattice)
    return F.when(inv > 0, 1 / F.sqrt(inv))


def strained_d(d0: Column, h: Column, k: Column, l: Column, lattice: Column, scales: Column) -> Column:
    """A line's d after the axes of its cell were scaled; null where indices, cell or metric do not say.

    ``d0`` is multiplied by the ratio of the two metric spacings, so it stays as it is at scale 1.
    """
    squeezed = F.struct(*[(lattice[n] * scales[n] if n in "abc" else lattice[n]).alias(n)
                          for n in ("a", "b", "c", "alpha", "beta", "gamma")])
    return d0 * F.try_divide(d_from_lattice(h, k, l, squeezed), d_from_lattice(h, k, l, lattice))
