"""Electron wavelength, contrast transfer and frequency-space gains."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Physical constants in SI units.
PLANCK = 6.62607015e-34
LIGHT_SPEED = 299792458.0
ELECTRON_MASS = 9.1093837015e-31
ELEMENTARY_CHARGE = 1.602176634e-19


def wavelength(volts: Column) -> Column:
    """Relativistic electron wavelength in angstrom."""
    ev = F.lit(ELEMENTARY_CHARGE) * volts
    rest = 2 * ELECTRON_MASS * LIGHT_SPEED ** 2
    return F.lit(1e10 * PLANCK * LIGHT_SPEED) / F.sqrt(ev * (F.lit(rest) + ev))


def ctf_value(fy: Column, fx: Column, dfu: Column, dfv: Column, angle: Column, kv: Column, cs: Column, w: Column,
              phase: float = 0.0, bfactor: float | None = None) -> Column:
    """Contrast transfer at frequency (fy, fx) in 1/angstrom; kV, mm and degrees in."""
    lam = wavelength(kv * 1000.0)
    s2 = fx * fx + fy * fy
    defocus = F.lit(0.5) * (dfu + dfv + (dfu - dfv) * F.cos(F.lit(2.0) * (F.atan2(fy, fx) - F.radians(angle))))
    gamma = F.lit(2 * math.pi) * (
        F.lit(-0.5) * defocus * lam * s2 + F.lit(0.25) * (cs * 1e7) * lam * lam * lam * s2 * s2
    ) - F.lit(math.radians(phase))
    value = -(F.sqrt(F.lit(1.0) - w * w) * F.sin(gamma) - w * F.cos(gamma))
    return value if bfactor is None else value * F.exp(F.lit(-bfactor / 4) * s2)


def fom_weight(fsc: Column) -> Column:
    """Figure of merit sqrt(2F / (1 + F)), F clipped to [0, 1]."""
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fsc))
    return F.sqrt(F.lit(2.0) * f / (F.lit(1.0) + f))


def raised_cosine_gain(r: Column, freq: float, delta: float = 0.01) -> Column:
    """1 below ``freq``, 0 above ``freq + delta``, half a cosine between."""
    return (F.when(r < freq, F.lit(1.0)).when(r > freq + delta, F.lit(0.0))
            .otherwise((F.cos(F.lit(math.pi) * (r - F.lit(freq)) / F.lit(delta)) + 1.0) / 2.0))


def soft_sphere(z: Column, y: Column, x: Column, side: int, radius: float = -1.0, edge: float = 3.0) -> Column:
    """1 inside the radius, raised cosine over ``edge`` voxels, 0 beyond; centre side / 2."""
    c = F.lit(side / 2.0)
    rad = side / 2.0 if radius < 0 else radius
    r = F.sqrt((z - c) * (z - c) + (y - c) * (y - c) + (x - c) * (x - c))
    return (F.when(r <= rad, F.lit(1.0)).when(r >= rad + edge, F.lit(0.0))
            .otherwise(F.lit(0.5) + F.lit(0.5) * F.cos(F.lit(math.pi) * (r - F.lit(rad)) / F.lit(edge))))


def gridding_gain(z: Column, y: Column, x: Column, side: int, floor: float = 1e-3) -> Column:
    """Separable sinc^2 of the centred voxel position, with a floor."""
    def axis(i: Column) -> Column:
        t = F.lit(math.pi) * (i - F.lit((side - 1) / 2.0)) / F.lit(float(side))
        return F.when(t == 0, F.lit(1.0)).otherwise(F.pow(F.sin(t) / t, F.lit(2.0)))
    return F.greatest(axis(z) * axis(y) * axis(x), F.lit(float(floor)))


# Coefficients of the rational formula for the error function.
ERF_SCALE = 0.3275911
ERF_TERMS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    """Normal distribution function by a published 5-term rational formula (error below 1.5e-7)."""
    a = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_SCALE) * a)
    poly = F.lit(0.0)
    for c in reversed(ERF_TERMS):
        poly = (poly + F.lit(c)) * t
    erf = F.lit(1.0) - poly * F.exp(-a * a)
    return F.lit(0.5) * (F.lit(1.0) + F.when(z < 0, -erf).otherwise(erf))


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))))


def combined_score(p: Column, w: Column) -> Column:
    """Probability times matching weight; half the probability when there is no weight."""
    missing = w.isNull() | F.isnan(w)
    return F.when(missing, F.lit(0.5) * p).otherwise(p * w)
