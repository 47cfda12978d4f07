"""Rotations as nine plain columns, so that every formula is generated code.

A matrix is a list of nine Columns in row order. Angles are ZYZ in degrees.
Functions named ``with_*`` add columns; the trigonometric values then exist
once per row, whatever is built on top of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from orientlake.functions.symmetry import group_matrices

Matrix = list[Column]


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def entries(prefix: str) -> list[str]:
    return [f"{prefix}{i}{j}" for i in range(3) for j in range(3)]


def matrix_of(prefix: str) -> Matrix:
    return [F.col(c) for c in entries(prefix)]


def with_matrix(df: DataFrame, rot: str, tilt: str, psi: str, prefix: str = "r") -> DataFrame:
    """Rotation matrix Rz(rot) Ry(tilt) Rz(psi) as columns ``<prefix>00`` .. ``<prefix>22``."""
    trig = {}
    for tag, angle in (("a", rot), ("b", tilt), ("g", psi)):
        rad = F.radians(F.col(angle))
        trig[f"_c{tag}"], trig[f"_s{tag}"] = F.cos(rad), F.sin(rad)
    ca, sa, cb, sb, cg, sg = (F.col(c) for c in ("_ca", "_sa", "_cb", "_sb", "_cg", "_sg"))
    cells = [
        ca * cb * cg - sa * sg, -ca * cb * sg - sa * cg, ca * sb,
        sa * cb * cg + ca * sg, -sa * cb * sg + ca * cg, sa * sb,
        -sb * cg, sb * sg, cb,
    ]
    return df.withColumns(trig).withColumns(dict(zip(entries(prefix), cells))).drop(*trig)


def euler_of(m: Matrix) -> tuple[Column, Column, Column]:
    """(rot, tilt, psi) in degrees; at tilt 0 or 180 the in-plane turn goes to psi."""
    def clip(c):
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))

    pole = m[2] * m[2] + m[5] * m[5] < F.lit(1e-14)
    tilt = F.degrees(F.acos(clip(m[8])))
    rot = F.when(pole, F.lit(0.0)).otherwise(F.degrees(F.atan2(m[5], m[2])))
    psi = F.when(pole & (m[8] > 0), F.degrees(F.atan2(m[3], m[4]))) \
        .when(pole, F.degrees(F.atan2(m[3], m[4]))) \
        .otherwise(F.degrees(F.atan2(m[7], -m[6])))
    return rot, tilt, psi


def multiply(a: Matrix, b: Matrix) -> Matrix:
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def multiply_transposed(a: Matrix, b: Matrix) -> Matrix:
    """a times the transpose of b."""
    return [a[3 * i] * b[3 * j] + a[3 * i + 1] * b[3 * j + 1] + a[3 * i + 2] * b[3 * j + 2]
            for i in range(3) for j in range(3)]


def _scaled(v: float, c: Column) -> Column | None:
    if v == 0.0:
        return None
    return c if v == 1.0 else (-c if v == -1.0 else F.lit(v) * c)


def _sum(terms) -> Column:
    kept = [t for t in terms if t is not None]
    total = kept[0] if kept else F.lit(0.0)
    for t in kept[1:]:
        total = total + t
    return total


def constant_times(s: tuple[float, ...], b: Matrix) -> Matrix:
    """Constant matrix times column matrix, zero terms left out."""
    return [_sum(_scaled(s[3 * i + k], b[3 * k + j]) for k in range(3)) for i in range(3) for j in range(3)]


def times_constant(a: Matrix, s: tuple[float, ...]) -> Matrix:
    return [_sum(_scaled(s[3 * k + j], a[3 * i + k]) for k in range(3)) for i in range(3) for j in range(3)]


def constant_vector(s: tuple[float, ...], v: list[Column]) -> list[Column]:
    return [_sum(_scaled(s[3 * i + k], v[k]) for k in range(3)) for i in range(3)]


def trace(m: Matrix) -> Column:
    return m[0] + m[4] + m[8]


def angle_of_trace(t: Column) -> Column:
    """Turning angle in degrees of a rotation with trace ``t``."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (t - 1.0) / 2.0))))


def magnitude(m: Matrix) -> Column:
    return angle_of_trace(trace(m))


def trace_between(a: Matrix, b: Matrix) -> Column:
    """Trace of a times transposed b: the sum of all entry products."""
    return _sum(x * y for x, y in zip(a, b))


def pose_error(a: Matrix, b: Matrix) -> Column:
    return angle_of_trace(trace_between(a, b))


# Groups with more operators than this are tried for a batch of rows at once, since their expression outgrows compiled code.
FEW_OPERATORS = 8


def largest_of_traces(p: list[np.ndarray], symmetry: str) -> np.ndarray:
    """The largest trace of S P over all operators S, from the nine entries of P.

    Terms are added in the order of the plain expression, zero terms left out.
    """
    most = None
    for s in group_matrices(symmetry):
        total = None
        for j in range(3):
            for k in range(3):
                if s[3 * j + k] != 0.0:
                    term = s[3 * j + k] * p[3 * k + j]
                    total = term if total is None else total + term
        most = total if most is None else np.maximum(most, total)
    return most


def largest_trace(symmetry: str):
    """Column function of the nine entries of P: the largest trace of S P over all operators S."""
    @F.pandas_udf(T.DoubleType())
    def best(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series,
             g: pd.Series, h: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series(largest_of_traces([s.to_numpy(dtype=float, na_value=np.nan) for s in (a, b, c, d, e, f, g, h, i)], symmetry))
    return best


def with_sym_error(df: DataFrame, a: str, b: str, symmetry: str, name: str = "err") -> DataFrame:
    """Smallest angle between matrix ``a`` and S b over all operators S of the group.

    The largest trace is taken first, so one arc cosine serves all operators.
    """
    product = dict(zip(entries("_p"), multiply_transposed(matrix_of(b), matrix_of(a))))
    p = matrix_of("_p")
    if len(group_matrices(symmetry)) > FEW_OPERATORS:
        return df.withColumns(product).withColumn("_t", largest_trace(symmetry)(*p)).withColumn(
            name, angle_of_trace(F.col("_t"))).drop(*product, "_t")
    traces = [_sum(_scaled(s[3 * i + j], p[3 * j + i]) for i in range(3) for j in range(3))
              for s in group_matrices(symmetry)]
    best = traces[0] if len(traces) == 1 else F.greatest(*traces)
    return df.withColumns(product).withColumn("_t", best).withColumn(
        name, angle_of_trace(F.col("_t"))).drop(*product, "_t")


def quaternion_gap(a: Matrix, b: Matrix) -> Column:
    """1 - <q, p>^2 of the unit quaternions of two rotations, written with the trace."""
    return (F.lit(3.0) - trace_between(a, b)) / 4.0


def view_of_angles(rot: Column, tilt: Column) -> list[Column]:
    r, t = F.radians(rot), F.radians(tilt)
    return [F.sin(t) * F.cos(r), F.sin(t) * F.sin(r), F.cos(t)]


def angles_of_view(v: list[Column]) -> tuple[Column, Column]:
    rot = F.pmod(F.degrees(F.atan2(v[1], v[0])), F.lit(360.0))
    return rot, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v[2]))))


def view_distance(v: list[Column], target: tuple[float, float, float], symmetry: str) -> Column:
    """Angle in degrees from view ``v`` to the nearest symmetry copy of a constant target view."""
    dots = []
    for s in group_matrices(symmetry):
        copy = [sum(s[3 * i + k] * target[k] for k in range(3)) for i in range(3)]
        dots.append(_sum(_scaled(c, x) for c, x in zip(copy, v)))
    best = dots[0] if len(dots) == 1 else F.greatest(*dots)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), best))))


def canonical_view(v: list[Column], symmetry: str, fold: int) -> Column:
    """The symmetry copy of a view in the asymmetric unit, as struct (x, y, z).

    First by height, then by distance from the middle of the sector, then by
    plain azimuth; sizes are rounded so that equal copies tie in every engine.
    """
    sector = F.lit(2 * 3.141592653589793 / fold)
    copies = []
    for i, s in enumerate(group_matrices(symmetry)):
        x, y, z = constant_vector(s, v)
        phi = F.atan2(y, x)
        centred = F.pmod(phi + sector / 2, sector) - sector / 2
        copies.append(F.struct(F.round(-z, 9).alias("a"), F.round(F.abs(centred), 9).alias("b"),
                               F.round(F.abs(phi), 9).alias("c"), F.lit(i).alias("i"),
                               x.alias("x"), y.alias("y"), z.alias("z")))
    return copies[0] if len(copies) == 1 else F.least(*copies)


def normal_euler(rot: Column, tilt: Column, psi: Column) -> tuple[Column, Column, Column]:
    """Angles modulo 360 with tilt reflected into [0, 180]."""
    full = F.lit(360.0)
    r, t, p = (F.pmod(c, full) for c in (rot, tilt, psi))
    over = t > 180.0
    return (F.when(over, F.pmod(r + 180.0, full)).otherwise(r),
            F.when(over, full - t).otherwise(t),
            F.when(over, F.pmod(p + 180.0, full)).otherwise(p))
