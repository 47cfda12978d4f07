"""Rotation grids as closed formulas of the grid index.

Nothing here is a stored table: the direction of cone ``p`` of the equal-area
ring layout, the angles of local grids and the ball grid all follow from an
integer column, so a grid of any size costs one expression per row.
"""

from __future__ import annotations

import json
import math
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def cone_count(order: int) -> int:
    return 12 * 4 ** order


def psi_count(order: int) -> int:
    return 6 * 2 ** order


def grid_size(order: int) -> int:
    return cone_count(order) * psi_count(order)


def cone_view(cone: Column, order: int) -> tuple[Column, Column]:
    """(azimuth in radians, height z) of a cone of the equal-area ring layout."""
    n = 2 ** order
    cap, total = 2 * n * (n - 1), 12 * n * n
    p = cone.cast("bigint")

    def ring(h: Column) -> Column:
        return (F.floor(F.sqrt(h - F.sqrt(F.floor(h).cast("double")))) + 1).cast("bigint")

    h = (p + 1) / F.lit(2.0)
    i = ring(h)
    j = p + 1 - 2 * i * (i - 1)
    north_z = 1 - i * i / F.lit(3.0 * n * n)
    north_a = (j - F.lit(0.5)) * F.lit(math.pi / 2) / i
    q = p - cap
    bi = F.floor(q / F.lit(4.0 * n)).cast("bigint") + n
    bj = F.pmod(q, F.lit(4 * n)) + 1
    shift = F.lit(0.5) * (1 + F.pmod(bi + n, F.lit(2)))
    belt_z = (2 * n - bi) * F.lit(2.0 / (3 * n))
    belt_a = (bj - shift) * F.lit(math.pi / (2 * n))
    s = F.lit(total) - p
    si = ring(s / F.lit(2.0))
    sj = 4 * si + 1 - (s - 2 * si * (si - 1))
    south_z = -1 + si * si / F.lit(3.0 * n * n)
    south_a = (sj - F.lit(0.5)) * F.lit(math.pi / 2) / si
    north, belt = p < cap, p < total - cap
    return (F.when(north, north_a).when(belt, belt_a).otherwise(south_a),
            F.when(north, north_z).when(belt, belt_z).otherwise(south_z))


def grid_angles(index: Column, order: int) -> tuple[Column, Column, Column]:
    """(rot, tilt, psi) in degrees of grid rotation ``index``; cone = index div psi_count."""
    k = psi_count(order)
    azimuth, z = cone_view(F.floor(index / F.lit(float(k))), order)
    return F.degrees(azimuth), F.degrees(F.acos(z)), F.pmod(index, F.lit(k)) * F.lit(360.0 / k)


@lru_cache(maxsize=4)
def grid_matrices(order: int) -> np.ndarray:
    """The same grid as a constant [P, 9] array for task kernels (P = 72 * 8^order)."""
    n, k = 2 ** order, psi_count(order)
    cap, total = 2 * n * (n - 1), 12 * n * n
    p = np.arange(total)
    azimuth, z = np.empty(total), np.empty(total)

    def ring(h):
        return (np.floor(np.sqrt(h - np.sqrt(np.floor(h)))) + 1).astype(np.int64)

    m = p < cap
    i = ring((p[m] + 1) / 2)
    z[m], azimuth[m] = 1 - i * i / (3 * n * n), (p[m] + 1 - 2 * i * (i - 1) - .5) * math.pi / 2 / i
    m = (p >= cap) & (p < total - cap)
    q = p[m] - cap
    i, j = q // (4 * n) + n, q % (4 * n) + 1
    z[m], azimuth[m] = (2 * n - i) * 2 / (3 * n), (j - .5 * (1 + (i + n) % 2)) * math.pi / (2 * n)
    m = p >= total - cap
    s = total - p[m]
    i = ring(s / 2)
    z[m], azimuth[m] = -1 + i * i / (3 * n * n), (4 * i + 1 - (s - 2 * i * (i - 1)) - .5) * math.pi / 2 / i
    rot, tilt = np.repeat(azimuth, k), np.repeat(np.arccos(z), k)
    psi = np.tile(np.arange(k) * 2 * math.pi / k, total)
    return zyz_matrices(np.degrees(rot), np.degrees(tilt), np.degrees(psi)).reshape(-1, 9)


def zyz_matrices(rot, tilt, psi) -> np.ndarray:
    """[N, 3, 3] matrices of ZYZ angles in degrees."""
    a, b, g = np.radians(rot), np.radians(tilt), np.radians(psi)
    ca, sa, cb, sb, cg, sg = np.cos(a), np.sin(a), np.cos(b), np.sin(b), np.cos(g), np.sin(g)
    return np.stack([ca * cb * cg - sa * sg, -ca * cb * sg - sa * cg, ca * sb,
                     sa * cb * cg + ca * sg, -sa * cb * sg + ca * cg, sa * sb,
                     -sb * cg, sb * sg, cb], axis=-1).reshape(*np.shape(ca), 3, 3)


@lru_cache(maxsize=4)
def view_bins(order: int) -> tuple[int, int, list[list[int]]]:
    """Bands of equal height, sectors of equal azimuth, and per bin the cones that a rotation viewed in it may be nearest to.

    The nearest rotation of the grid is no farther than the nearest cone plus
    half an in-plane step, and no nearer than its own cone. With ``r`` from
    the middle of a bin to its corners and ``d`` from there to the nearest
    cone, only cones within d + 2 r + half a step of the middle can win.
    """
    bands, sectors = 3 * 2 ** order, 6 * 2 ** order
    views = grid_matrices(order).reshape(-1, 3, 3)[::psi_count(order), :, 2]

    def direction(z, a):
        s = np.sqrt(np.maximum(0, 1 - z * z))
        return np.stack([s * np.cos(a), s * np.sin(a), z], axis=-1)

    edge, turn = np.linspace(-1, 1, bands + 1), np.linspace(0, 2 * math.pi, sectors + 1)
    low, west = np.meshgrid(edge[:-1], turn[:-1], indexing="ij")
    high, east = np.meshgrid(edge[1:], turn[1:], indexing="ij")
    middle = direction((low + high) / 2, (west + east) / 2).reshape(-1, 3)
    corners = np.stack([direction(z, a).reshape(-1, 3) for z in (low, high) for a in (west, east)])
    radius = np.arccos(np.clip((corners * middle).sum(axis=-1), -1, 1)).max(axis=0)
    away = np.arccos(np.clip(middle @ views.T, -1, 1))
    reach = away.min(axis=1) + 2 * radius + math.pi / psi_count(order) + 1e-6
    return bands, sectors, [np.flatnonzero(row <= r).tolist() for row, r in zip(away, reach)]


@lru_cache(maxsize=4)
def _bin_table(order: int) -> tuple[int, int, np.ndarray]:
    """``view_bins`` as one array: row per bin, its cones in ascending order, the last one repeated up to equal length."""
    bands, sectors, cones = view_bins(order)
    longest = max(map(len, cones))
    return bands, sectors, np.array([row + [row[-1]] * (longest - len(row)) for row in cones], dtype=np.int64)


def nearest_index(order: int, rot: np.ndarray, tilt: np.ndarray, psi: np.ndarray) -> np.ndarray:
    """Index of the grid rotation with the largest trace (lowest index on ties) for finite angles in degrees."""
    k = psi_count(order)
    step = 2 * math.pi / k
    bands, sectors, table = _bin_table(order)
    first = grid_matrices(order).reshape(-1, 9)[::k]  # in-plane angle 0: rotation by azimuth, then by tilt
    m = zyz_matrices(rot, tilt, psi).reshape(-1, 9)
    band = np.clip(np.floor((m[:, 8] + 1) * (bands / 2)), 0, bands - 1).astype(np.int64)
    sector = np.minimum(np.floor(np.mod(np.arctan2(m[:, 5], m[:, 2]), 2 * math.pi) * (sectors / (2 * math.pi))), sectors - 1).astype(np.int64)
    listed = table[band * sectors + sector]
    best, index = np.full(len(m), -np.inf), np.zeros(len(m), np.int64)
    for cone in listed.T:
        g = first[cone]

        def dot(i: int, j: int) -> np.ndarray:
            return g[:, i] * m[:, j] + g[:, 3 + i] * m[:, 3 + j] + g[:, 6 + i] * m[:, 6 + j]

        c, s, z = dot(0, 0) + dot(1, 1), dot(1, 0) - dot(0, 1), dot(2, 2)
        low = np.floor(np.arctan2(s, c) / step)
        for i in (0, 1):
            turn = (low + i) * step
            trace = np.round(c * np.cos(turn) + s * np.sin(turn) + z, 9)
            number = cone * k + np.mod(low + i, k).astype(np.int64)
            better = (trace > best) | ((trace == best) & (number < index))
            best, index = np.where(better, trace, best), np.where(better, number, index)
    return index


def nearest_grid_index(order: int):
    """Column function of (rot, tilt, psi): index of the grid rotation with the largest trace (lowest index on ties).

    A rotation's view falls into one bin, and the bin's constant list of cones
    is tried, for all rows of a batch at once. For a cone the trace is a cosine
    of the in-plane angle, so the two steps around its peak decide. No row
    meets the whole grid. A missing angle has no index.
    """
    @F.pandas_udf(T.LongType())
    def nearest(rot: pd.Series, tilt: pd.Series, psi: pd.Series) -> pd.Series:
        angles = [s.to_numpy(dtype=float, na_value=np.nan) for s in (rot, tilt, psi)]
        whole = np.isfinite(angles[0]) & np.isfinite(angles[1]) & np.isfinite(angles[2])
        out = pd.Series(np.zeros(len(whole), np.int64), dtype="Int64")
        out[~whole] = pd.NA
        if whole.any():
            out[whole] = nearest_index(order, *[a[whole] for a in angles])
        return out
    return nearest


def local_steps(distance: float, step: float) -> int:
    """Odd number of grid points per axis of a local grid."""
    n = math.ceil(2 * distance / step)
    return n if n % 2 else n + 1


def local_offsets(distance: float, step: float) -> list[float]:
    n = local_steps(distance, step)
    return [-distance + 2 * distance * i / (n - 1) if n > 1 else 0.0 for i in range(n)]


def local_grid_array(distance: float, step: float, prefix: str | None = None) -> Column:
    """Constant array of (cand, drot, dtilt, dpsi), row-major, to be exploded next to a pose.

    With ``prefix`` each also has the nine entries of its matrix. The array is
    given as one text, so it is read once and not built for every row.
    """
    off = local_offsets(distance, step)
    points = []
    for c, angles in enumerate(product(off, repeat=3)):
        cells = {f"{prefix}{k // 3}{k % 3}": float(v) for k, v in enumerate(zyz_matrices(*angles).ravel())} if prefix else {}
        points.append({"cand": c, **dict(zip(("drot", "dtilt", "dpsi"), map(float, angles))), **cells})
    names = list(points[0])[1:]
    return F.from_json(F.lit(json.dumps(points)), "array<struct<cand int, " + ", ".join(f"{n} double" for n in names) + ">>")


def ball_cell(spacing: float) -> float:
    """Edge of the cubic cells of the ball grid, in units of half-turn sines."""
    return math.radians(spacing) / math.sqrt(3)


@lru_cache(maxsize=8)
def ball_grid(distance: float, spacing: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit quaternions [N, 4] (scalar first) of all rotations of a lattice within ``distance``, and their Haar weights.

    A rotation by angle t about axis u has the vector sin(t / 2) u. The
    vectors of the grid are a body-centred cubic lattice around zero, so
    neighbours are ``spacing`` apart near the identity, and on this vector the
    Haar measure has density 1 / sqrt(1 - |q|^2). Weights follow it and add up
    to the fixed total of 4 pi^2 (1 - cos distance). Points come in the order
    of z, y, x.
    """
    rim, cell = math.sin(math.radians(distance) / 2), ball_cell(spacing)
    # places in half cells: all even or all odd
    reach = math.floor(2 * rim / cell + 1e-9)
    z, y, x = np.meshgrid(*[np.arange(-reach, reach + 1)] * 3, indexing="ij")
    same = (z % 2 == y % 2) & (y % 2 == x % 2)
    v = np.stack([x[same], y[same], z[same]], axis=1) * (cell / 2)
    square = (v * v).sum(axis=1)
    inside = square <= rim * rim * (1 + 1e-12)
    v, scalar = v[inside], np.sqrt(1 - square[inside])
    weight = 1 / scalar
    return np.concatenate([scalar[:, None], v], axis=1), 4 * math.pi ** 2 * (1 - math.cos(math.radians(distance))) * weight / weight.sum()


def quaternion_matrices(q: np.ndarray) -> np.ndarray:
    """[N, 9] matrices of unit quaternions, scalar first."""
    w, x, y, z = q.T
    return np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
                     2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
                     2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], axis=1)


def ball_grid_array(distance: float, spacing: float) -> Column:
    """The ball grid as one constant array of (cand, weight, m00..m22) structs, given as one text."""
    q, w = ball_grid(distance, spacing)
    names = [f"m{k // 3}{k % 3}" for k in range(9)]
    points = [{"cand": i, "weight": float(w[i]), **dict(zip(names, map(float, row)))} for i, row in enumerate(quaternion_matrices(q))]
    kind = "array<struct<cand int, weight double, " + ", ".join(f"{n} double" for n in names) + ">>"
    return F.from_json(F.lit(json.dumps(points)), kind)
