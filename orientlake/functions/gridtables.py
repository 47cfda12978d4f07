"""Constant tables of a rotation grid: neighbours, symmetry equivalents, representatives.

Their size depends on the grid order alone, never on the data.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from orientlake.functions.grids import grid_matrices, zyz_matrices
from orientlake.functions.symmetry import group_matrices


@lru_cache(maxsize=8)
def equivalents(order: int, symmetry: str) -> np.ndarray:
    """[P, S] index of the grid rotation nearest to S R for each operator."""
    grid = grid_matrices(order)
    out = []
    for s in group_matrices(symmetry):
        turned = (np.array(s).reshape(3, 3) @ grid.reshape(-1, 3, 3)).reshape(-1, 9)
        rows = [np.round(turned[i:i + 512] @ grid.T, 9).argmax(axis=1) for i in range(0, len(grid), 512)]
        out.append(np.concatenate(rows))
    return np.stack(out, axis=1)


@lru_cache(maxsize=8)
def representatives(order: int, symmetry: str) -> np.ndarray:
    """[P] index of the equivalent that stands for each rotation: the one with least (turn, index)."""
    eq = equivalents(order, symmetry)
    turn = np.round(np.arccos(np.clip((grid_matrices(order)[:, [0, 4, 8]].sum(axis=1) - 1) / 2, -1, 1)), 5)
    standing = np.empty(len(turn), np.int64)
    standing[np.lexsort((np.arange(len(turn)), turn))] = np.arange(len(turn))
    return np.take_along_axis(eq, standing[eq].argmin(axis=1)[:, None], axis=1)[:, 0]


def nearest_k(order: int, k: int):
    """Pandas UDF: the k nearest grid rotations of a pose as array of (idx, gap), nearest first."""
    kind = T.ArrayType(T.StructType([T.StructField("idx", T.LongType()), T.StructField("gap", T.DoubleType())]))

    @F.pandas_udf(kind)
    def near(rot: pd.Series, tilt: pd.Series, psi: pd.Series) -> pd.Series:
        grid = grid_matrices(order)
        m = zyz_matrices(rot.to_numpy(), tilt.to_numpy(), psi.to_numpy()).reshape(-1, 9)
        out = []
        step = max(1, (1 << 22) // len(grid))
        for i in range(0, len(m), step):
            t = m[i:i + step] @ grid.T
            idx = np.argsort(-np.round(t, 9), axis=1, kind="stable")[:, :k]
            gap = (3 - np.take_along_axis(t, idx, 1)) / 4
            out += [[{"idx": int(a), "gap": float(b)} for a, b in zip(x, y)] for x, y in zip(idx, gap)]
        return pd.Series(out)
    return near


@lru_cache(maxsize=8)
def grid_neighbours(order: int, k: int) -> np.ndarray:
    """[P, k] nearest rotations within the grid, itself first."""
    grid = grid_matrices(order)
    rows = [np.argsort(-np.round(grid[i:i + 512] @ grid.T, 9), axis=1, kind="stable")[:, :k] for i in range(0, len(grid), 512)]
    return np.concatenate(rows)


def neighbour_pose(probabilities: np.ndarray, order: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean rotation [N, 9] of the winners' grid neighbours weighted by their probabilities, and the sums of those."""
    from orientlake.operators.consensus import nearest_rotations
    grid, near = grid_matrices(order), grid_neighbours(order, k)
    idx = near[np.round(probabilities, 12).argmax(axis=1)]
    w = np.take_along_axis(probabilities, idx, 1)
    mean = np.einsum("nk,nkc->nc", w / w.sum(axis=1, keepdims=True), grid[idx])
    return nearest_rotations(mean.reshape(-1, 3, 3)).reshape(-1, 9), w.sum(axis=1)
